"""Mixture, shuffle, split and sampler jobs (Mix family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mixture as M
from ..operators import ranking as K
from ..sources.tables import read_table
from .registry import query

SEED = 42


def _md5(*parts: str) -> str:
    inner = ", ':', ".join(parts)
    return f"md5(concat('{SEED}', ':', {inner}))"


_SHUFFLE_SQL = f"""
SELECT doc_id, source, row_number() OVER (ORDER BY {_md5('cast(doc_id AS varchar)')}, doc_id) AS position
FROM documents"""


@query("seeded_shuffle", ids=("L1",), sql=_SHUFFLE_SQL)
def q_seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    return M.shuffled(d, "doc_id", SEED)


def _mixture_spec(spark: SparkSession, sf_dir: str, test: float | None) -> M.MixtureSpec:
    d = read_table(spark, sf_dir, "documents")
    cols = ["doc_id", "source", "n_chars"]
    return M.MixtureSpec(
        entries=[
            M.MixtureEntry("src0", d.filter(F.col("source") == "src0"), "doc_id", cols, 0.25),
            M.MixtureEntry("src1", d.filter(F.col("source") == "src1"), "doc_id", cols, 0.5),
            M.MixtureEntry("rest", d.filter(~F.col("source").isin("src0", "src1")), "doc_id", cols, None),
        ],
        seed=SEED,
        test_split_size=test,
    )


_MIX_CTE = f"""
e0 AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY {_md5('cast(doc_id AS varchar)')}, doc_id) AS rk,
              count(*) OVER () AS n FROM documents WHERE source = 'src0'),
e1 AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY {_md5('cast(doc_id AS varchar)')}, doc_id) AS rk,
              count(*) OVER () AS n FROM documents WHERE source = 'src1'),
u AS (SELECT doc_id, source, n_chars, 'src0' AS mixture_entry FROM e0 WHERE rk <= floor(n * 0.25)
      UNION ALL SELECT doc_id, source, n_chars, 'src1' FROM e1 WHERE rk <= floor(n * 0.5)
      UNION ALL SELECT doc_id, source, n_chars, 'rest' FROM documents WHERE source NOT IN ('src0', 'src1')),
m AS (SELECT *, row_number() OVER (ORDER BY {_md5('mixture_entry', 'cast(doc_id AS varchar)')}, mixture_entry,
                                   cast(doc_id AS varchar)) AS position FROM u)"""

_MIX_SQL = f"WITH {_MIX_CTE} SELECT * FROM m"


@query("mixture_weighted", ids=("L2", "L3", "U1", "P1", "P2"), sql=_MIX_SQL)
def q_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources subsampled exactly (¼, ½) plus all other sources, concatenated and shuffled."""
    return M.build_mixture(_mixture_spec(spark, sf_dir, None))["train"]


_SPLIT_SQL = f"""WITH {_MIX_CTE}
SELECT *, CASE WHEN position <= ceil((SELECT count(*) FROM m) * 0.2) THEN 'test' ELSE 'train' END AS split FROM m"""


@query("mixture_train_test_split", ids=("L4",), sql=_SPLIT_SQL)
def q_mixture_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = M.build_mixture(_mixture_spec(spark, sf_dir, 0.2))
    return parts["train"].withColumn("split", F.lit("train")).unionByName(parts["test"].withColumn("split", F.lit("test")))


_REPEAT_SQL = f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_md5('cast(doc_id AS varchar)')}, doc_id) AS rk,
                  count(*) OVER () AS n FROM documents),
c AS (SELECT doc_id, (rk - 1) // 3 AS chunk, (rk - 1) % 3 AS i FROM r WHERE (rk - 1) // 3 < n // 3)
SELECT doc_id, CAST(chunk * 12 + rep * 6 + i * 2 + mm AS BIGINT) AS sample_pos
FROM c, (SELECT range AS rep FROM range(2)) a, (SELECT range AS mm FROM range(2)) b"""


@query("repeat_sampler", ids=("L6",), sql=_REPEAT_SQL)
def q_repeat_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled chunks of 3 documents, each chunk twice, each index twice in a row."""
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    return M.repeat_sampler(d, "doc_id", mini_repeat_count=2, batch_size=3, repeat_count=2, shuffle=True, seed=SEED)


_CHUNK_SQL = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rk, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST((rk - 1) // (n // 7) AS BIGINT) AS chunk FROM r WHERE (rk - 1) // (n // 7) < 7"""


@query("split_into_chunks", ids=("L8",), sql=_CHUNK_SQL)
def q_split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    return M.split_into_chunks(d, ["doc_id"], 7)


_FIRST_SQL = "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10"


@query("first_n_rows", ids=("L7",), sql=_FIRST_SQL)
def q_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 longest documents (the limit is the feature)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    return M.first_n(d, [F.col("n_chars").desc(), F.col("doc_id")], 10)


_SLICE_SQL = """
SELECT doc_id, source FROM (
  SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS rk FROM documents)
WHERE rk > 100 AND rk <= 300"""


@query("row_range_slice", ids=("SRC7",), sql=_SLICE_SQL)
def q_row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows [100, 300) of the table ordered by (source, doc_id): one chunk of a chunked job."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    return K.row_slice(d, ["source", "doc_id"], 100, 300)


_BATCH_SQL = """
SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id,
       CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 64 AS BIGINT) AS batch
FROM conversations"""


@query("row_ids_batches", ids=("W4", "W5"), sql=_BATCH_SQL)
def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn"])
    return K.batch_ids(c, ["conv_id", "turn"], 64)


_PAD_SQL = f"""
WITH d AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS rk, count(*) OVER () AS n FROM documents),
p AS (SELECT n, unnest(range((32 - n % 32) % 32)) AS i FROM (SELECT count(*) AS n FROM documents)),
k AS (SELECT CAST(('0x' || substring(md5(concat('{SEED}:', i)), 1, 8)) AS BIGINT) % n + 1 AS rk FROM p)
SELECT doc_id, source, false AS is_padding FROM documents
UNION ALL SELECT doc_id, source, true FROM d JOIN k ON d.rk = k.rk
"""


@query("pad_to_multiple", ids=("L5",), sql=_PAD_SQL)
def q_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows drawn with replacement until the row count is a multiple of 32."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    return M.pad_to_multiple(d, "doc_id", 32, seed=SEED)
