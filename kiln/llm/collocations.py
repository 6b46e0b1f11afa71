"""Phrase collocations counted over a prefix-free parse.

Where three words in a row hash to a trigger, a piece of text is cut: the chunk
before ends with the three words and the next one begins with them. Cuts depend
on content alone, so equal passages give equal chunks, and no chunk is a proper
prefix of another. The distinct chunks with their parse frequencies are the
dictionary; n-grams are counted inside it, weighted. A phrase of up to four words
lies whole in some chunk; one that lies in an overlap belongs to the chunk that
begins there, so each occurrence is counted once.

Words travel as 64-bit hashes, so that counting is array work; the parse also
gives each word's string, count and a second hash. Should two words share a hash,
the second one tells, and the parse is made again with another seed. Counting goes
by length: pairs of frequent words, then triples of frequent pairs, both by a hash
of the sequence in packed arrays (one blob for each task and bucket); then all
phrases whose triples or pairs are frequent, by their words. What is frequent
reaches the tasks as bit filters of bounded size. A filter or sequence hash can
only let too much through, and the last counts are of words, so the result is
exact.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.sizing import broadcast_if_small
from .common import delete_path, query, read, saved, shared_path

LONGEST, OVERLAP = 4, 3
#: One trigger in so many places.
RARITY = 16
#: Bytes of text handled at a time, words or chunk bytes a worker holds before it hands them on.
BLOCK_BYTES, HELD_WORDS, HELD_BYTES = 4 << 20, 400_000, 32 << 20
#: Phrase places held before equal ones are merged, and entries that one bucket of pairs holds.
HELD_PLACES, BUCKET_ENTRIES = 1_000_000, 4_000_000
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: Most bits of a filter (16 MB); a fuller filter lets more through, the counts stay exact.
FILTER_BITS = 1 << 27

_BREAK, _NONE = 0, 1
_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)


def _mix(state: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = (state ^ h) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def lang_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang))


class Lexicon(dict):
    """Words to local numbers, with their hashes; 0 is a break between pieces, and its hash is 0."""

    def __init__(self, seed: int = 0):
        super().__init__({b"\n": _BREAK, b"": _NONE})
        self.words: list[bytes] = [b"\n", b""]
        self.seed, self.codes, self.counts = seed, array("Q", [0, 0]), np.zeros(2, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.codes.append(xxhash.xxh64_intdigest(word, self.seed) or 1)
        return n

    def ids(self, block: bytes) -> np.ndarray:
        """Numbers of the words of a lower-cased text whose breaks are newlines."""
        words = block.replace(b"\n", b" \n ").split(b" ")
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out[out != _NONE]

    def hashed(self, block: bytes) -> np.ndarray:
        """Hashes of the words (0 at a break); the words are counted."""
        ids = self.ids(block)
        counts = np.bincount(ids, minlength=len(self.words))
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        return np.array(self.codes, np.uint64)[ids]


def triggers(h: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Where a trigger begins; ``same``: does the next word belong to the same piece?"""
    out = np.zeros(len(h), bool)
    if len(h) >= OVERLAP:
        win = _mix(_mix(_mix(np.zeros(1, np.uint64), h[:-2]), h[1:-1]), h[2:])
        out[:-2] = same[:-1] & same[1:] & (win % np.uint64(RARITY) == 0)
    return out


def chunk_bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every chunk of the parse of word hashes with 0 for breaks."""
    word = h != 0
    begin = word & ~np.r_[False, word[:-1]]
    ends = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    starts = np.flatnonzero(begin | triggers(h, word[:-1] & word[1:]))
    if not len(starts):
        return starts, starts
    piece = ends[np.searchsorted(ends, starts, side="right")]
    after = np.r_[starts[1:], ends[-1]]
    return starts, np.where(after < piece, after + OVERLAP, piece)


def blocks(text: bytes) -> Iterator[bytes]:
    """A text, lower-cased and with newlines for breaks, cut between pieces."""
    data, at = text.translate(_TABLE), 0
    while at < len(data):
        cut = data.find(b"\n", at + BLOCK_BYTES)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut]
        at = cut + 1


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


#: Chunks (``key``: eight bytes a word) and words (``key``: the string, with its two hashes).
PARSED = pa.schema(
    [("lang", pa.string()), ("is_word", pa.bool_()), ("key", pa.binary()), ("hash", pa.int64()), ("check", pa.int64()), ("freq", pa.int64())]
)
PARSED_DDL = "lang string, is_word boolean, key binary, hash long, check long, freq long"


def parse(seed: int = 0):
    """``lang, text`` -> :data:`PARSED`, pre-aggregated by task."""

    def run(batches):
        lexicons: dict[str, Lexicon] = {}
        chunks: dict[str, Counter] = {}
        held = 0

        def flush():
            for lang, found in chunks.items():
                keys = list(found)
                for i in range(0, len(keys), 50_000):
                    some = keys[i : i + 50_000]
                    none = [0] * len(some)
                    yield _rows(PARSED, [lang] * len(some), [False] * len(some), some, none, none, [found[k] for k in some])
            for lang, lex in lexicons.items():
                for i in range(2, len(lex.counts), 50_000):
                    some = lex.words[i : i + 50_000]
                    codes = np.array(lex.codes[i : i + 50_000], np.uint64).view(np.int64)
                    checks = np.array([xxhash.xxh64_intdigest(w, seed + 0x5EED) for w in some], np.uint64).view(np.int64)
                    yield _rows(PARSED, [lang] * len(some), [True] * len(some), some, codes, checks, lex.counts[i : i + 50_000])
            lexicons.clear()
            chunks.clear()

        def count(lang: str, block: bytes) -> int:
            h = lexicons.setdefault(lang, Lexicon(seed)).hashed(block)
            raw = h.tobytes()
            a, b = chunk_bounds(h)
            found = chunks.setdefault(lang, Counter())
            before = len(found)
            found.update([raw[x:y] for x, y in zip((8 * a).tolist(), (8 * b).tolist())])
            return 100 * (len(found) - before)

        for batch in batches:
            langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
            codes = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                queue, size = [], 0
                for i in [*np.flatnonzero(codes == k).tolist(), -1]:
                    if i >= 0 and texts[i].is_valid:
                        for block in blocks(bytes(texts[i].as_buffer())):
                            queue.append(block)
                            size += len(block)
                    if queue and (size >= BLOCK_BYTES or i < 0):
                        held += count(lang, b"\n".join(queue))
                        queue, size = [], 0
                        if held > HELD_BYTES or sum(map(len, lexicons.values())) > HELD_WORDS:
                            yield from flush()
                            held = 0
        yield from flush()

    return run


class View:
    """The chunks of a batch ``lang, key, freq`` as arrays over their words."""

    def __init__(self, batch: pa.RecordBatch):
        langs, keys = batch.column(0).dictionary_encode(), batch.column(1)
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
        n = (offsets[-1] - offsets[0]) // 8
        self.words = np.frombuffer(keys.buffers()[2], np.uint64, n, offsets[0]) if n else np.zeros(0, np.uint64)
        self.langs = langs.dictionary.to_pylist()
        chunk = np.repeat(np.arange(len(keys)), np.diff(offsets) // 8)
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[chunk]
        self.weight = batch.column(2).to_numpy()[chunk]
        self.same = chunk[1:] == chunk[:-1]  # is the next word of the same chunk?
        ends = np.flatnonzero(triggers(self.words, self.same) & np.r_[False, self.same][: len(chunk)])
        self.owned = np.ones(len(chunk), bool)
        self.owned[(ends[:, None] + np.arange(OVERLAP)).ravel()] = False  # a trigger behind the begin ends the chunk
        seeds = np.array([lang_seed(x) for x in self.langs], np.uint64)
        self.one = _mix(seeds[self.lang], self.words)  # hash of each word in its language
        self.two = _mix(self.one[:-1], self.words[1:])  # of the pair that begins there
        self.three = _mix(self.two[:-1], self.words[2:])

    def pairs_of(self, words: Bits) -> np.ndarray:
        """Where a pair of words that pass begins."""
        good = words.has(self.one)
        return self.same & good[:-1] & good[1:]

    def triples_of(self, pairs: Bits) -> np.ndarray:
        """Where a triple of pairs that pass begins."""
        good = self.same.copy()
        good[good] = pairs.has(self.two[good])
        return good[:-1] & good[1:]


class Bits:
    """A bit filter over 64-bit hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bit_filter(hashes: DataFrame, col: str, most_bits: int = FILTER_BITS) -> Bits:
    """The filter of a column of hashes, put together on executors; what reaches the driver is bounded by ``most_bits``."""
    n = 1 << 16
    while n < most_bits and n < 32 * hashes.count():
        n *= 2
    at = F.col(col).bitwiseAND(F.lit(n - 1))
    parts = (
        hashes.groupBy(F.bitmap_bucket_number(at + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits"))
        .collect()
    )
    out = np.zeros(n // 8, np.uint8)
    for r in parts:
        out[4096 * (r["bucket"] - 1) : 4096 * r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return Bits(out)


def _merged(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, w = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(k, kind="stable")
    k, w = k[order], w[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(w, first) if len(k) else w


PACKED = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
PACKED_DDL = "bucket int, hashes binary, counts binary"


def pack_counts(n: int, passed: Bits, buckets: int):
    """Chunks -> blobs by bucket of the hashes and counts of pairs (of words that pass) or triples (of pairs that pass)."""

    def run(batches):
        keys, weights, held = [], [], 0

        def merge() -> int:
            k, w = _merged(keys, weights)
            keys[:], weights[:] = [k], [w]
            return len(k)

        def flush():
            if not keys:
                return
            merge()
            k, w = keys[0], weights[0]
            bucket = (k >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            k, w, bucket = k[order], w[order], bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(k) else []
            ends = np.r_[first[1:], len(k)].astype(np.int64)
            for i in range(0, len(first), 256):
                spans = list(zip(first[i : i + 256].tolist(), ends[i : i + 256].tolist()))
                yield _rows(PACKED, bucket[first[i : i + 256]].astype(np.int32), [k[a:b].tobytes() for a, b in spans], [w[a:b].tobytes() for a, b in spans])
            keys.clear()
            weights.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            v = View(batch)
            at, code = (v.pairs_of(passed), v.two) if n == 2 else (v.triples_of(passed), v.three)
            at = at & v.owned[: len(at)]
            keys.append(code[at])
            weights.append(v.weight[: len(at)][at])
            held += len(keys[-1])
            if held > HELD_PLACES:
                held = merge()
                if held > HELD_PLACES // 2:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def frequent_hashes(least: int):
    """The blobs of one bucket -> hashes counted ``least`` times or more."""

    def run(group: pa.Table) -> pa.Table:
        k = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        w = [np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist()]
        k, w = _merged(k, w)
        return pa.table({"hash": k[w >= least].view(np.int64)})

    return run


GRAMS = pa.schema([("lang", pa.string()), *[(f"w{i}", pa.int64()) for i in range(LONGEST)], ("f", pa.int64())])
GRAMS_DDL = "lang string, w0 long, w1 long, w2 long, w3 long, f long"


def count_phrases(pairs: Bits, triples: Bits):
    """Chunks -> ``lang, w0 .. w3, f``: phrases of 2 to 4 words (by word hash, null beyond the end) that pass the filters."""

    def run(batches):
        held: dict[int, list] = {}
        places = 0

        def flush():
            for n, parts in held.items():
                code, lang, ids, w = (np.concatenate(x) for x in list(zip(*parts))[:4])
                order = np.argsort(code, kind="stable")
                code, lang, ids, w = code[order], lang[order], ids[order], w[order]
                # Neighbours of equal code, language and words are one phrase; a code that two phrases share splits into runs.
                differs = (code[1:] != code[:-1]) | (lang[1:] != lang[:-1]) | (ids[1:] != ids[:-1]).any(axis=1)
                first = np.flatnonzero(np.r_[True, differs])
                total, lang, ids = np.add.reduceat(w, first), lang[first], ids[first].view(np.int64)
                for i in range(0, len(first), 100_000):
                    some = ids[i : i + 100_000]
                    named = pa.DictionaryArray.from_arrays(pa.array(lang[i : i + 100_000], pa.int32()), pa.array(names)).dictionary_decode()
                    columns = [pa.array(some[:, c]) if c < n else pa.nulls(len(some), pa.int64()) for c in range(LONGEST)]
                    yield pa.RecordBatch.from_arrays([named, *columns, pa.array(total[i : i + 100_000])], schema=GRAMS)
            held.clear()

        names: list[str] = []
        number: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = View(batch)
            for x in v.langs:
                if x not in number:
                    number[x] = len(names)
                    names.append(x)
            lang = np.array([number[x] for x in v.langs], np.int32)[v.lang]
            good = v.triples_of(pairs)
            good[good] = triples.has(v.three[good])
            pair = v.same.copy()
            pair[pair] = pairs.has(v.two[pair])
            for n, at, code in ((2, pair, v.two), (3, good, v.three), (4, good[:-1] & good[1:], None)):
                at = np.flatnonzero(at & v.owned[: len(at)])
                if len(at):
                    code = v.three[at] ^ v.words[at + 3] if code is None else code[at]
                    held.setdefault(n, []).append((code, lang[at], v.words[at[:, None] + np.arange(n)], v.weight[at]))
                    places += len(at)
            if places > HELD_PLACES:
                yield from flush()
                places = 0
        yield from flush()

    return run


def parsed_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """``(chunks, words, folder)`` of the parse of ``lang, text``; the seed is one under which no two words share a hash."""
    spark, seed = rows.sparkSession, 0
    while True:
        path = shared_path(spark, "parse")
        found = rows.mapInArrow(parse(seed), PARSED_DDL).groupBy("is_word", "lang", "key", "hash", "check").agg(F.sum("freq").alias("freq"))
        found.write.option("compression", "zstd").partitionBy("is_word").parquet(path)
        table = spark.read.schema(PARSED_DDL).parquet(path)
        words = table.filter("is_word").select("lang", F.col("key").alias("word"), "hash", "check", F.col("freq").alias("f"))
        shared = words.groupBy("hash").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b")
        if shared.isEmpty():
            return table.filter("NOT is_word").select("lang", "key", "freq"), words, path
        delete_path(spark, path)
        seed += 1


def phrase_counts(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(lang, words, phrase, f)`` of all phrases of 1 to 4 words found ``least`` times or more, and ``(lang, n)``.

    A null language is ``und``, a null text empty; a language without words has no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    chunks, words, path = parsed_tables(rows)
    totals = saved(words.groupBy("lang").agg(F.sum("f").alias("n")))
    often = saved(words.filter(F.col("f") >= least).select("lang", "hash", F.decode("word", "UTF-8").alias("word"), "f"))
    size = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_ENTRIES))

    def frequent(n: int, passed: Bits) -> Bits:
        packed = chunks.mapInArrow(pack_counts(n, passed, buckets), PACKED_DDL)
        return bit_filter(saved(packed.groupBy("bucket").applyInArrow(frequent_hashes(least), "hash long")), "hash")

    in_lang = often.select("lang", "hash").mapInArrow(_hashes_in_lang, "hash long")
    pairs = frequent(2, bit_filter(saved(in_lang), "hash"))
    grams = chunks.mapInArrow(count_phrases(pairs, frequent(3, pairs)), GRAMS_DDL)
    keys = [f"w{i}" for i in range(LONGEST)]
    grams = saved(grams.groupBy("lang", *keys).agg(F.sum("f").alias("f")).filter(F.col("f") >= least))
    delete_path(spark, path)

    # Strings for the words of the phrases that are left.
    name, _ = broadcast_if_small(often.select(F.col("lang").alias("_lang"), F.col("hash").alias("_hash"), "word"), max_rows=300_000, max_bytes=32 << 20)
    named = grams
    for k in keys:
        same = (F.col("lang") == F.col("_lang")) & (F.col(k) == F.col("_hash"))
        named = named.join(name, same, "left").withColumnRenamed("word", f"_{k}").drop("_lang", "_hash")
    count = F.lit(2) + F.col("w2").isNotNull().cast("int") + F.col("w3").isNotNull().cast("int")
    phrases = named.select("lang", count.alias("words"), F.concat_ws(" ", *[f"_{k}" for k in keys]).alias("phrase"), "f")
    singles = often.select("lang", F.lit(1).alias("words"), F.col("word").alias("phrase"), "f")
    return saved(singles.unionByName(phrases)), totals


def _hashes_in_lang(batches):
    """``lang, hash`` of words -> the hash of each word in its language."""
    for b in batches:
        langs = b.column(0).dictionary_encode()
        seeds = np.array([lang_seed(x) for x in langs.dictionary.to_pylist()], np.uint64)
        if b.num_rows:
            own = _mix(seeds[langs.indices.to_numpy(zero_copy_only=False)], b.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["hash"])


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to 4 words found ``least`` times or more scores
    ``floor(2000000 a / (l + r))`` at its worst cut into two parts (ties: the
    earliest cut). One that lies inside a longer such phrase found at least 80 %
    as often is dropped. Ties of score go to the larger ``a``, then the phrase.
    """
    found, totals = phrase_counts(docs, least, lang_col, text_col)
    longer = found.filter("words > 1").withColumnRenamed("f", "a")
    parts, _ = broadcast_if_small(found.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f")), max_rows=300_000, max_bytes=32 << 20)
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    left, right = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring_index(phrase, ' ', k - words)")
    cuts = longer.select("lang", "words", "phrase", "a", cut.alias("k")).select("*", left.alias("left"), right.alias("right"))

    def with_count(df: DataFrame, part: str, out: str) -> DataFrame:
        joined = df.join(parts, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part")))
        return joined.withColumnRenamed("_f", out).drop("_lang", "_part", part)

    cuts = with_count(with_count(cuts, "left", "l"), "right", "r")
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + r)")
    worst = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
        .select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    )
    inner = longer.filter("words > 2").withColumn("ws", F.split("phrase", " "))
    spans = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(ws, i, m), ' '))))"
    )
    inside = (
        inner.select(F.col("lang").alias("_lang"), F.explode(spans).alias("_part"), "a")
        .groupBy("_lang", "_part")
        .agg(F.max("a").alias("_most"))
    )
    kept = worst.join(inside, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")), "left").filter(
        "_most IS NULL OR 5 * CAST(_most AS DECIMAL(20,0)) < 4 * CAST(a AS DECIMAL(20,0))"
    )
    # The best of each part of a language first, so that no task gets all of its phrases.
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("_part_of")
    ranked = kept.select("*", part).drop("_lang", "_part", "_most")
    for by in (["lang", "_part_of"], ["lang"]):
        order = Window.partitionBy(*by).orderBy(*best)
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    named = totals.select(F.col("lang").alias("_of"), "n")
    return ranked.join(F.broadcast(named) if totals.count() <= 10_000 else named, F.col("lang") == F.col("_of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


OP12_SQL = r"""
WITH p AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t
    FROM documents)),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, m.m AS words, array_to_string(w[i : i + m.m - 1], ' ') AS phrase
  FROM i, (VALUES (1), (2), (3), (4)) m(m) WHERE i + m.m - 1 <= len(w)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, CAST((CAST(k.a AS HUGEINT) * 2000000) // (x.f + y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1 : k], ' ')
         JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT c.lang, array_to_string(ws[j : j + m.m - 1], ' ') AS part, max(a) AS most
  FROM (SELECT *, unnest(range(1, words + 1)) AS j FROM c) c, (VALUES (2), (3)) m(m)
  WHERE m.m < words AND j + m.m - 1 <= words GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.part = b.phrase WHERE o.most IS NULL OR 100 * o.most < 80 * b.a)
SELECT q.lang, q.rank, q.phrase, q.a, q.l, q.r, t.n, q.score FROM q JOIN t ON t.lang = q.lang WHERE q.rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark, sf_dir):
    """The 2,000 best phrases of each language of all ``documents``."""
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))
