"""Line dedup over levelled sorted runs of line hashes.

A run is a sorted table ``k1, k2, n_docs, last_doc``: for each key of a line (two
64-bit hashes) the number of documents that hold it and the largest of their
ids. Each new batch of documents adds one run to level 0; when a level holds
``fanout`` runs they are merged into one run of the next level, so a key lies in
few runs and old rows are rewritten only a logarithmic number of times. A table is
deduplicated in a second pass against all runs: the final counts and the largest id
are known only after the last batch.

Only DataFrame functions run here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from .common import SPACE_CHARS, ascii_lower, delete_path, query, read, saved, shared_path

MIN_CHARS = 20
MIN_DOCS = 3
#: Bound on what may be broadcast of dropped line places; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _text_hashes(text: Column) -> list[Column]:
    """With the id, they tell which text a line place belongs to."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def _keyed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, t1, t2, pos, k1, k2`` of the lines whose key is long enough."""
    keys = F.transform(lines_of(F.col(text_col)), line_key)
    lines = docs.select(
        F.col(id_col).alias("doc_id"), *_text_hashes(F.col(text_col)), F.posexplode(keys).alias("pos", "key")
    ).filter(F.length("key") >= MIN_CHARS)
    return lines.select("doc_id", "t1", "t2", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"))


def _run_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One batch's keys: a line that stands twice in a document counts once."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.length(k) >= MIN_CHARS))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(keys).alias("key"))
    return (
        rows.select("doc_id", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"))
        .groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    )


def _merged(runs: list[DataFrame]) -> DataFrame:
    return (
        reduce(DataFrame.unionByName, runs)
        .groupBy("k1", "k2")
        .agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
    )


class LineRuns:
    """The levelled runs in a folder that driver and executors share.

    Batches may come from different calls over days: a store opened again with
    the ``levels`` it printed goes on where it was.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 3, levels=None):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or shared_path(spark, "line-runs")
        self.levels: list[list[str]] = [list(x) for x in levels or []]
        self._made = sum(map(len, self.levels))

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{self._made:06d}"
        self._made += 1
        rows.sortWithinPartitions("k1", "k2").write.parquet(path)
        return path

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.parquet(p) for level in self.levels for p in level]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add a batch's lines as a new run, then compact full levels."""
        self._put(0, self._write(_run_of(docs, id_col, text_col)))

    def _put(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self._write(_merged([self.spark.read.parquet(p) for p in old]))
            self.levels[level] = []
            for p in old:
                delete_path(self.spark, p)
            self._put(level + 1, merged)

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """``k1, k2, last_doc`` of the keys found in at least ``min_docs`` documents."""
        runs = self.runs()
        both = runs[0] if len(runs) == 1 else _merged(runs)
        return both.filter(F.col("n_docs") >= min_docs).select("k1", "k2", "last_doc")


def dedup_lines(
    docs: DataFrame, runs: LineRuns, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; every row stays.

    Lines whose key (stripped, A-Z lowered) has at least 20 code points and lies
    in ``min_docs`` documents of the runs go, but for those of the largest id
    holding it. A null or empty text is one empty line. Rows with one id count as
    a document each and lose their own repeated lines; a null id is never the largest
    and loses its repeated lines unless all holders have null ids.
    """
    hits = saved(runs.repeated(min_docs))
    side, _ = broadcast_if_small(hits, BROADCAST_ROWS, BROADCAST_BYTES)
    lines = _keyed_lines(docs, id_col, text_col)
    gone = saved(
        lines.join(side, ["k1", "k2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .groupBy(F.col("doc_id").alias("_gone_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
        .agg(F.collect_set("pos").alias("_gone"))
    )
    n = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()
    small = n[0] <= BROADCAST_ROWS and n[0] * 80 + n[1] * 4 <= BROADCAST_BYTES
    gone = F.broadcast(gone) if small else gone
    split = lines_of(F.col(text_col))
    kept = F.when(F.col("_gone").isNull(), split).otherwise(
        F.filter(split, lambda _, i: ~F.array_contains(F.col("_gone"), i))
    )
    t1, t2 = _text_hashes(F.col(text_col))
    own = F.col(id_col).eqNullSafe(F.col("_gone_id")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2"))
    return (
        docs.join(gone, own, "left")
        .withColumn("n_lines", F.size(split).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .withColumn("kept_text", F.array_join(kept, "\n"))
        .drop("_gone", "_gone_id", "_t1", "_t2")
    )


def id_batches(docs: DataFrame, batches: int, id_col: str = "doc_id") -> list[DataFrame]:
    """``docs`` cut into id ranges of equal width, as they might have arrived (null ids come first)."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    if low is None or batches < 2:
        return [docs]
    cuts = [low + (high - low + 1) * i // batches for i in range(1, batches)]
    at = F.col(id_col)
    first = docs.filter(at.isNull() | (at < cuts[0]))
    middle = [docs.filter((at >= a) & (at < b)) for a, b in zip(cuts, cuts[1:])]
    return [first, *middle, docs.filter(at >= cuts[-1])]


def dedup_table(docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All batches of a table into the runs, then the whole table against them."""
    runs = LineRuns(docs.sparkSession)
    for b in id_batches(docs, batches, id_col):
        runs.add(b, id_col, text_col)
    return dedup_lines(docs, runs, id_col, text_col)


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
r AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.last_doc AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark, sf_dir):
    """Every whole text of ``documents`` without the lines that repeat across documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_table(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
