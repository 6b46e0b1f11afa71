"""Import every operator module of this subpackage, so that its queries register."""

from . import bpe, chat, collocations, framed, line_runs, mixing, near_dedup, perplexity, prefix_trie, quality_rules, sharding, topk, warc  # noqa: F401
from .common import ORACLE_SQL, QUERIES  # noqa: F401
