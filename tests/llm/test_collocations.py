"""Phrase collocations against plain counting, and the parse's own laws."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from kiln.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase int, f string, freq long, _lang int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def pieces(t):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", lower(t))]


def counts(rows):
    f = {}
    for t, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        for w in pieces(t):
            for n in (1, 2, 3, 4):
                own.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return f


def brute(rows, least=30, top=2000):
    out = []
    for lang, f in counts(rows).items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        good = {k: a for k, a in f.items() if len(k) > 1 and a >= least}
        found = []
        for k, a in good.items():
            cut = min((2000000 * a // (f[k[:c]] + f[k[c:]]), c) for c in range(1, len(k)))
            inside = any(
                5 * b >= 4 * a for long, b in good.items()
                if len(long) > len(k) and any(long[i : i + len(k)] == k for i in range(len(long) - len(k) + 1))
            )
            if not inside:
                found.append((-cut[0], -a, " ".join(k).encode(), f[k[: cut[1]]], f[k[cut[1] :]]))
        out += [(lang, i, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def fixture(seed=1, docs=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "é", "漢字", "x-y", "\x1c", "a\xa0b", *[f"w{i}" for i in range(12)]]
    passage = " ".join(rng.choices(words, k=300))
    rows = []
    for i in range(docs):
        body = []
        for _ in range(rng.randrange(1, 40)):
            body.append(rng.choice(words))
            body.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b"]))
        if i % 3 == 0:
            body.append(passage)
        rows.append(("".join(body), ["en", "en", "de", None][i % 4]))
    return [*rows, (None, "en"), ("", None), ("...", "fr"), ("the " * 3000, "en"), *[("same copy of it", "de")] * 60]


def test_equals_plain_counting(spark):
    rows = fixture()
    for least, top in ((30, 2000), (2, 50)):
        got = sorted(map(tuple, C.collocations(table(spark, rows), least=least, top=top).collect()))
        assert got == brute(rows, least, top) and len(got) > 20
    # the same rows dealt otherwise
    again = sorted(map(tuple, C.collocations(table(spark, rows).repartition(7), least=2, top=50).collect()))
    assert again == got


def test_empty_table_and_texts(spark):
    assert C.collocations(table(spark, [])).collect() == []
    assert C.collocations(table(spark, [(None, None), ("", "en"), (" .\n", "en")])).collect() == []


def test_counts_are_whole_with_small_buffers_and_a_full_filter(monkeypatch):
    """Every buffer bound at its smallest, in process: nothing is lost at a flush, overlaps count once."""
    for name, v in (("BLOCK_BYTES", 40), ("HELD_WORDS", 15), ("HELD_BYTES", 900), ("HELD_PLACES", 30), ("RARITY", 2)):
        monkeypatch.setattr(C, name, v)
    rows = fixture(2, 40)
    batch = pa.RecordBatch.from_pydict(
        {"lang": pa.array([r[1] or "und" for r in rows]), "text": pa.array([None if r[0] is None else r[0].encode() for r in rows], pa.binary())}
    )
    parsed, words, name = Counter(), Counter(), {}
    for b in C.parse()([batch]):
        for lang, is_word, key, h, _, n in zip(*(b.column(i).to_pylist() for i in range(6))):
            if is_word:
                words[lang, key.decode()] += n
                name[h] = key.decode()
            else:
                parsed[lang, key] += n
    want = counts(rows)
    assert words == Counter({(lang, k[0]): v for lang, f in want.items() for k, v in f.items() if len(k) == 1})
    keys = sorted(parsed)
    chunks = pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.binary()), pa.array([parsed[k] for k in keys], pa.int64())],
        names=["lang", "key", "freq"],
    )
    pieces_of = [chunks.slice(i, 7) for i in range(0, chunks.num_rows, 7)]
    full, grams = C.Bits(np.full(8192, 255, np.uint8)), Counter()
    for b in C.count_phrases(full, full)(pieces_of):
        for lang, *ws, f in zip(*(b.column(i).to_pylist() for i in range(6))):
            grams[lang, " ".join(name[w] for w in ws if w is not None)] += f
    assert grams == Counter({(lang, " ".join(k)): v for lang, f in want.items() for k, v in f.items() if len(k) > 1})
    # pairs and triples, packed: their sums by hash are the sums by string
    for n in (2, 3):
        packed = Counter()
        for b in C.pack_counts(n, full, 5)(pieces_of):
            for h, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for x, y in zip(np.frombuffer(h, np.uint64).tolist(), np.frombuffer(c, np.int64).tolist()):
                    packed[x] += y
        assert sorted(packed.values()) == sorted(v for f in want.values() for k, v in f.items() if len(k) == n)


def test_parse_is_prefix_free_and_rebuilds_the_text(monkeypatch):
    monkeypatch.setattr(C, "RARITY", 3)
    rng = random.Random(5)
    text = b"\n".join(b" ".join(rng.choices([b"a", b"b", b"c", b"d"], k=rng.randrange(1, 60))) for _ in range(50))
    h = C.Lexicon().hashed(text)
    starts, ends = C.chunk_bounds(h)
    chunks = {tuple(h[a:b].tolist()) for a, b in zip(starts, ends)}
    inner = {tuple(h[a:b].tolist()) for a, b in zip(starts, ends) if b < len(h) and h[b] != 0}
    assert not any(x != y and y[: len(x)] == x for x in inner for y in inner)
    back = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        joined = back and a and h[a - 1] != 0
        back = back[: -C.OVERLAP] if joined else back + ([0] if back else [])
        back += h[a:b].tolist()
    assert back == h.tolist() and len(chunks) > 20


def test_words_that_share_a_hash_make_another_seed(spark, monkeypatch):
    """The second hash tells: a first parse in which two words collide is thrown away."""
    real = C.parse

    def bad_first(seed=0):
        run = real(seed)

        def shared(batches):
            for b in run(batches):
                yield b.set_column(3, "hash", pa.array([5] * b.num_rows, pa.int64())) if seed == 0 else b

        return shared

    monkeypatch.setattr(C, "parse", bad_first)
    rows = [("a b c", "en")] * 40
    got = sorted(map(tuple, C.collocations(table(spark, rows)).collect()))
    assert got == brute(rows)


def test_bit_filter(spark):
    rng = np.random.default_rng(3)
    own, other = rng.integers(-(2**63), 2**63, 4000), rng.integers(-(2**63), 2**63, 4000)
    bits = C.bit_filter(spark.createDataFrame([(int(x),) for x in own], "hash long"), "hash")
    assert bits.has(own.view(np.uint64)).all() and bits.has(other.view(np.uint64)).mean() < 0.05
    small = C.bit_filter(spark.createDataFrame([(int(x),) for x in own], "hash long"), "hash", most_bits=1 << 16)
    assert small.has(own.view(np.uint64)).all() and len(small.bits) == 8192


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    assert sorted(map(tuple, C.op12(spark, sf).collect())) == brute(rows)
