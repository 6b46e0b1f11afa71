"""BPE encoding and decoding by batched numpy merge rounds.

A batch of documents is cut at blanks and newlines into chunks. Chunks not met
before are normalised and pre-tokenized with the vocabulary's own rules, and the
symbols of all their words lie in one flat array. Each round looks up every
neighbouring pair by binary search over the sorted pair keys, finds each word's
lowest rank, and merges that pair wherever it stands in the word; finished words
leave the array. Repeated chunks cost one dictionary access.
"""

from __future__ import annotations

import itertools
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import query, read
from .flat_memo import FlatMemo

#: Bytes of chunks and ids a worker remembers; beyond that it starts anew (a matter of memory, not of results).
MEMO_BYTES = 32 << 20
#: Bytes of text, and ids, that a worker turns at a time; a longer text is cut at blanks.
SLICE_BYTES, SLICE_IDS = 1 << 19, 1 << 18

_NONE = np.iinfo(np.int64).max


class MergeTable:
    """Merge ranks as sorted pair keys, plus the vocabulary both ways."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = vocab
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.kind = np.uint32 if self.width**2 < 1 << 32 else np.int64  # half the keys to search where they fit
        self.keys, self.rank, self.made = keys[order].astype(self.kind), order.astype(np.int64), made[order]
        codes = [ord(t) for t in vocab if len(t) == 1]
        self.inner = np.full(max(codes) + 1, -1, dtype=np.int64)
        self.last = self.inner.copy()
        for c in codes:
            self.inner[c], self.last[c] = vocab[chr(c)], vocab.get(chr(c) + self.suffix, -1)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([self.width - 1, *self.added.values()]) + 1
        self.tokens = [""] * size
        for table in (vocab, self.added):
            for tok, i in table.items():
                self.tokens[i] = tok

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starting symbols of all words (characters, the last with the end-of-word suffix) and each one's word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        sym = self.inner[codes]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[codes[ends]]
        return sym, np.repeat(np.arange(len(words)), lengths)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has (words of byte-level characters, not empty)."""
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        sym, word = self.symbols(words)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            made = np.zeros(len(sym), dtype=np.int64)
            if len(sym) > 1:
                inside = np.flatnonzero(word[:-1] == word[1:])
                pair = (sym[inside] * self.width + sym[inside + 1]).astype(self.kind)
                at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
                hit = self.keys[at] == pair
                inside, at = inside[hit], at[hit]
                rank[inside] = self.rank[at]
                made[inside] = self.made[at]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lens = np.diff(np.r_[starts, len(sym)])
            low = np.repeat(np.minimum.reduceat(rank, starts), lens)
            over = low == _NONE
            if over.any():  # words without a further merge leave
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, made, low = sym[keep], word[keep], rank[keep], made[keep], low[keep]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == low)
            # Overlapping places ("aaa"): every second one of a run, from its left end.
            run = np.cumsum(np.r_[True, np.diff(pick) != 1]) - 1
            head = pick[np.flatnonzero(np.r_[True, np.diff(run) != 0])]
            pick = pick[(pick - head[run]) % 2 == 0]
            sym[pick] = made[pick]
            drop = np.ones(len(sym), dtype=bool)
            drop[pick + 1] = False
            sym, word = sym[drop], word[drop]
        word = np.concatenate(done_word)
        return np.concatenate(done_sym)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class ChunkEncoder:
    """Encodes texts by their chunks (no blank or newline inside).

    The ids of all learned chunks lie in one flat array; the memo has each chunk's
    number, and a text is one gather over its chunks' ids.
    """

    def __init__(self, path: str):
        self.table = MergeTable(path)
        tok = Tokenizer.from_file(path)
        self.normalizer, self.pre = tok.normalizer, tok.pre_tokenizer
        self.special = re.compile("(" + "|".join(map(re.escape, self.table.added)) + ")") if self.table.added else None
        self.memo = FlatMemo()

    def pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokenized words of any chunk; an added token stands as its id."""
        out: list[str | int] = []
        for piece in self.special.split(chunk) if self.special else [chunk]:
            if piece in self.table.added:
                out.append(self.table.added[piece])
            elif piece:
                out += [w for w, _ in self.pre.pre_tokenize_str(self.normal(piece)) if w]
        return out

    def normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def odd(self, chunks: set[str]) -> list[str]:
        """The chunks with special strings or white space inside."""
        text = " ".join(chunks)
        if len(text.split()) == len(chunks) and not (self.special and self.special.search(text)):
            return []
        return [c for c in chunks if c.split() != [c] or (self.special and self.special.search(c))]

    def learn_odd(self, chunk: str) -> None:
        """A chunk with special strings or white space inside."""
        found = [np.array([w]) if isinstance(w, int) else self.table.encode_words([w])[0] for w in self.pieces(chunk)]
        ids = np.concatenate([np.empty(0, np.int64), *found])
        self.memo.put([chunk], ids, np.array([len(ids)]))

    def learn(self, chunks: list[str]) -> None:
        """Chunks without white space: normalised and cut in one go, merged in one array."""
        text = self.normal(" ".join(chunks))
        owners, words = [], []
        starts = np.cumsum([0, *[len(c) + 1 for c in text.split(" ")]])
        for lot in range(0, len(chunks), 500):
            end = min(lot + 500, len(chunks))
            for w, (at, _) in self.pre.pre_tokenize_str(text[starts[lot] : starts[end] - 1]):
                if w:
                    words.append(w)
                    owners.append(at + starts[lot])
        owner = np.searchsorted(starts, np.array(owners, dtype=np.int64), side="right") - 1
        ids, lengths = self.table.encode_words(words)
        self.memo.put(chunks, ids, np.bincount(owner, weights=lengths, minlength=len(chunks)).astype(np.int64))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets at which each begins (and the end)."""
        if self.memo.held > MEMO_BYTES:
            self.memo.clear()
        cut = [[c for c in (t or "").replace("\n", " ").split(" ") if c] for t in texts]
        known = self.memo.number.__contains__  # asked chunk by chunk: a set less the memo's keys walks through the whole memo
        new = set(itertools.filterfalse(known, set().union(*cut)))
        odd = self.odd(new)
        for c in odd:
            self.learn_odd(c)
        plain = list(new.difference(odd))
        if plain:
            self.learn(plain)
        numbers, at = self.memo.numbers(cut)
        ids, ends = self.memo.gather(numbers)
        return ids, np.r_[0, ends][at]


def parts(text: str | None, most: int = SLICE_BYTES) -> list[str]:
    """A text cut at blanks or newlines into parts of about ``most`` characters (words do not cross them)."""
    out, at = [], 0
    while text and len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        if cut <= at:  # one word longer than that
            found = [x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0]
            if not found:
                break
            cut = min(found)
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:] if text else ""]


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


@lru_cache(maxsize=2)
def _tokens(path: str) -> pa.Array:
    return pa.array(MergeTable(path).tokens, pa.string())


def _with_column(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _add(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], values], names=[*names, name])


def _slices(batches, sizes, most: int):
    """Runs of rows whose sizes (an array for each batch) add up to about ``most``."""
    for b in batches:
        total = np.cumsum(sizes(b), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(total // most, prepend=0)) if len(total) else []
        for x, y in zip([0, *cuts], [*cuts, b.num_rows]):
            if y > x:
                yield b.slice(x, y - x)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: array<int> of the whole text's ids.

    ``vocabulary`` is the path of a tokenizer file whose words do not cross
    blanks (it must drop white space); special strings in a text become their
    ids, as the vocabulary's own library does. A null text counts as empty and
    gives no ids; a column already called ``out`` is replaced.
    """

    def run(batches):
        enc = _encoder(vocabulary)
        for b in _slices(batches, lambda b: pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False), SLICE_BYTES):
            cut = [parts(t) for t in b.column(text_col).to_pylist()]
            ids, offsets = [], [np.zeros(1, np.int64)]
            flat = [p for ps in cut for p in ps]
            lengths = np.fromiter(map(len, flat), np.int64, len(flat))
            for lot in np.split(np.arange(len(flat)), np.flatnonzero(np.diff(np.cumsum(lengths) // SLICE_BYTES, prepend=0))):
                if len(lot):
                    got, at = enc.encode(flat[lot[0] : lot[-1] + 1])
                    ids.append(got)
                    offsets.append(at[1:] + offsets[-1][-1])
            ends = np.concatenate(offsets)[np.cumsum([0, *map(len, cut)])]
            values = pa.array(np.concatenate(ids))
            yield _add(b, out, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values))

    return docs.mapInArrow(run, _with_column(docs.schema, out, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the ids' tokens joined by one space (a vocabulary without a decoder).

    Null or empty ids give an empty text.
    """

    def run(batches):
        tokens = _tokens(vocabulary)
        for b in _slices(batches, lambda b: pc.fill_null(pc.list_value_length(b.column(ids_col)), 0).to_numpy(zero_copy_only=False), SLICE_IDS):
            ids = b.column(ids_col).fill_null([])
            first, last = ids.offsets[0].as_py(), ids.offsets[len(ids)].as_py()  # of this slice only
            words = pa.ListArray.from_arrays(pc.subtract(ids.offsets, first), tokens.take(ids.values.slice(first, last - first)))
            yield _add(b, out, pc.binary_join(words, " "))

    return docs.mapInArrow(run, _with_column(docs.schema, out, T.StringType()))


@query("op2_bpe_encode_decode")
def op2(spark, sf_dir):
    """Every whole text of ``documents`` encoded, then decoded; digests of both."""
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    marked = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"))
    return decode(marked, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
