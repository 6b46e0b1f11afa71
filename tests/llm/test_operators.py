"""Each operator against brute force, a round trip or the library it must equal, on small fixtures with odd rows."""

import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kiln.llm import bpe, chat, framed, line_runs, mixing, near_dedup, perplexity, quality_rules, sharding, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, _key int"
BASE = "the quick brown fox jumps over the lazy dog and runs far away from a very loud noise in the dark wood near home"


def docs(spark, texts, ids=None):
    rows = [
        (ids[i] if ids else i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), 9, i)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "a", "a a a a", BASE, BASE, BASE.upper(), "x" * 3000, "é ß Σ 漢字 😀", "tab\there\r\n end "]


def test_mixing_targets_and_balance(spark):
    texts = [" ".join(["w"] * (1 + i % 37)) for i in range(900)] + [None, ""]
    d = docs(spark, texts)
    got = mixing.mix_sources(d, mixing.n_words(F.col("text"))).collect()
    again = mixing.mix_sources(d.repartition(7), mixing.n_words(F.col("text"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == 902 and all(0 <= r["copies"] <= 3 for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["copies"] * r["size"]
        s[1] += r["size"]
    names = sorted(x for x in by if x is not None) + [None]
    total, weight = sum(s[1] for s in by.values()), {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    want, free = {}, set(names)
    while True:
        level = (total - sum(want.values())) / sum(weight[n] for n in free)
        over = {n for n in free if level * weight[n] > 3 * by[n][1]}
        if not over:
            break
        for n in over:
            want[n] = 3 * by[n][1]
        free -= over
    for n, (taken, size, target, source_size) in by.items():
        assert source_size == size and target == pytest.approx(want.get(n, level * weight[n]))
        assert abs(taken - target) <= 80


def test_cube_flight_keeps_constraints():
    rng = np.random.default_rng(1)
    size = sorted(rng.integers(1, 500, 400).tolist(), reverse=True)
    p = cube = mixing.cube_flight([0.3] * 400, [1] * 400, size, 5, land=True)
    assert set(cube) <= {0.0, 1.0} and abs(sum(p) - 120) <= 2
    assert abs(np.dot(p, size) - 0.3 * sum(size)) <= max(size)
    means = np.mean([mixing.cube_flight([0.3] * 20, [1] * 20, size[:20], s, land=True) for s in range(3000)], axis=0)
    assert np.abs(means - 0.3).max() < 0.05


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokenizers_equal_library(name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    lib.no_padding()
    lib.no_truncation()
    odd = ["<|endoftext|> a<|startoftext|>b", " a\x1cb", "x\n\ny", "aaaaaaa", "don't DON'T 123", "İß ΣΑΣ x　", *ODD]
    alphabet = list("abAB \n'é́.,12\t ") + ["the", "ing", "<|endoftext|>"]
    rng = np.random.default_rng(2)
    odd += ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(300)]
    enc = (bpe.ChunkEncoder if name[0] == "w" else framed.ChunkedTokenizer)(path)
    for _ in range(2):  # learned, then remembered
        if name[0] == "w":
            ids, at = enc.encode(odd)
            got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        else:
            got = [np.frombuffer(b, dtype="<u4").tolist() for b in enc.encode(odd)]
        assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_bpe_decode(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    out = bpe.decode(bpe.encode(docs(spark, ODD), path), path).collect()
    assert len(out) == len(ODD) and "_key" in out[0].asDict()
    for r in out:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs(spark, ODD).limit(0), path), path).count() == 0


def test_bpe_bounds_by_bytes(monkeypatch):
    """Slices, text parts and the memo at their smallest: the ids stay those of the library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for name, v in (("SLICE_BYTES", 40), ("MEMO_BYTES", 3000)):
        monkeypatch.setattr(bpe, name, v)
    texts = [*ODD, BASE * 9, "y" * 500 + " z\n" + "x" * 300, " ", None, "a\n\n b"]
    enc = bpe.ChunkEncoder(path)
    for t in texts:
        cut = bpe.parts(t, 40)
        assert " ".join(cut) == (t or "").replace("\n", " ") or len(cut) == 1 or all(cut)
        ids, at = enc.encode(cut)
        assert ids.tolist() == lib.encode(t or "", add_special_tokens=False).ids and at[-1] == len(ids)
    assert enc.memo.held < 30_000
    rows = [3, 90, 1, 1, 45, 0, 0, 200]
    batch = __import__("pyarrow").RecordBatch.from_pydict({"n": rows})
    got = list(bpe._slices([batch], lambda b: b.column(0).to_numpy(), 50))
    assert [x for b in got for x in b.column(0).to_pylist()] == rows and max(b.num_rows for b in got) < 6


def test_token_files_round_trip(spark, tmp_path):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "files")
    d = docs(spark, ODD, ids=[5, 4, None, 9, 9, 1, 2, 3, 0, 7, 6, 8])
    manifest = framed.write_token_files(d, folder, path, end_id=2, partitions=3)
    got = framed.read_token_files(spark, folder, manifest).collect()
    lib = Tokenizer.from_file(path)
    want = sorted(((r["doc_id"], lib.encode(r["text"] or "").ids + [2]) for r in d.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start, rows = 0, []
    for i, ids in want:
        rows.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(map(str, rows)) == sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [i for i, _ in want]
    for r in ordered:
        assert r["start"] == start
        start += r["n_tokens"]


def test_frames_random_access_and_damage(tmp_path):
    p, rng = tmp_path / "f.ktf", np.random.default_rng(3)
    all_ids = [rng.integers(0, 50000, n).astype("<u4") for n in (0, 5, 1000, 1, 0, 300)]
    with open(p, "wb") as f:
        w = framed.FrameWriter(f, frame_tokens=100)
        for ids in all_ids:
            w.add(ids.tobytes())
        w.close()
    fs, at = framed.open_fs(str(p))
    r = framed.FrameReader(fs.open_input_file(at))
    assert len(r.frames) > 1
    for i in (5, 0, 2, 4, 1, 3):
        assert r.document(i).tolist() == all_ids[i].tolist()
    data = bytearray(p.read_bytes())
    data[10] ^= 255
    p.write_bytes(bytes(data))
    with pytest.raises(Exception):
        framed.FrameReader(fs.open_input_file(at)).document(2)


@pytest.mark.parametrize("percent,k", [(80, 2), (80, 5)])
def test_near_duplicates_brute_force(spark, percent, k):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = rng.choice(vocab, 60).tolist()
        for _ in range(8):
            t = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 6)):
                t[at] = str(rng.choice(vocab))
            texts.append(" ".join(t))
    ids = [*rng.permutation(len(texts)).tolist()]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(spark, texts, ids), k, percent).collect()}
    sets = {i: near_dedup.shingle_set(t, k) for i, t in zip(ids, texts)}
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        inter = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    for i in ids:
        assert got[i]["component_id"] == find(i) and got[i]["n_shingles"] == len(sets[i])
        assert got[i]["kept"] == (find(i) == i)


def test_near_duplicates_null_ids_and_empty(spark):
    d = docs(spark, [BASE, BASE, None], ids=[None, 4, 5])
    got = near_dedup.near_duplicates(d, 5).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in got) == [(-1, True), (4, True), (5, True)]
    assert near_dedup.near_duplicates(d.limit(0), 5).count() == 0


def test_pruning_keeps_similar_pairs():
    rng, kept = np.random.default_rng(5), 0
    for _ in range(300):
        base = rng.integers(0, 2**63, 200).astype(np.uint64)
        other = np.r_[base[:178], rng.integers(0, 2**63, 22).astype(np.uint64)]
        a, b = (near_dedup.minhash(np.unique(x)).astype(np.uint8)[None, :] for x in (base, other))
        kept += int(near_dedup.sequential_matches(a, b, 80)[0] >= 0)
    assert kept == 300


def test_quality_metrics_and_bound(spark):
    texts = [*ODD, "one two three one two three four\nx\nx\n \n x", "#$% a|b <c> ***", "a b a b a b"]
    got = {r["doc_id"]: r for r in quality_rules.with_metrics(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        rep = {p for j, x in enumerate(win) if win.count(x) > 1 for p in (j, j + 1, j + 2)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(rep))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
    for n, share, level in [(0, 0.01, 0.05), (100, 0.01, 0.05), (3000, 0.01, 0.001), (20000, 0.002, 1e-4)]:
        k = spark.range(1).select(quality_rules.most_rejected(F.lit(n).cast("long"), share, F.lit(level)).alias("k")).first()["k"]
        logp = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share) for i in range(min(n, 200) + 1)]
        cdf = np.cumsum(np.exp(logp))
        assert k == int((cdf <= level).sum()) - 1


def test_quality_rules_on_moderate_strata(spark):
    """600 good documents of one language and 100 of another; 60 and 10 of symbol junk, 30 of repeated lines."""
    words, texts, langs, quality = BASE.split(), [], [], []
    rng = np.random.default_rng(8)

    def put(lang, q, text):
        texts.append(text)
        langs.append(lang)
        quality.append(q)

    plain = lambda: " ".join(f"{w}{rng.integers(1000)}" for w in rng.choice(words, 80))
    for lang, n_good, n_bad in ((None, 600, 60), ("xx", 100, 10)):
        for _ in range(n_good):
            put(lang, 1, plain())
        for _ in range(n_bad):
            put(lang, 0, plain() + " #$%&" * 30)
    for _ in range(30):
        put(None, 0, plain() + ("\n" + "again") * 12)
    for i in range(4):  # good ones that a stricter cutoff would reject
        texts[i] += " |" * 12
    d = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int")
    metrics = quality_rules.with_metrics(d).cache()
    assert quality_rules.choose_cutoffs(metrics, labels).count() == 0
    cutoffs = quality_rules.choose_by_sequence(metrics, labels)
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in cutoffs.collect()}
    assert {s for s, _ in got} == {None}  # 100 good documents show no bound of 1 %
    rows = [r.asDict() for r in metrics.drop("text").collect()]
    for r in rows:
        r["q"] = quality[r["doc_id"]]
    assert got == _sequence_cutoffs([r for r in rows if r["lang"] is None], 0.05 / 2)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_cutoffs(metrics, cutoffs).collect()}
    own = [r for r in rows if r["lang"] is None]
    assert not any(kept[r["doc_id"]] for r in own if r["q"] == 0) and all(kept[r["doc_id"]] for r in own if r["q"] == 1)
    assert all(kept[r["doc_id"]] for r in rows if r["lang"] == "xx" and not r["base_failed"])


def _sequence_cutoffs(rows, level):
    """The sequence test of one stratum (null) over plain rows: union by union."""
    rows = [r for r in rows if not r["base_failed"]]
    grid = quality_rules.GRID

    def above(r, rule, cut):
        top, bottom = quality_rules._VALUE[rule]
        return r[bottom] > 0 and r[top] / r[bottom] > cut

    hits = lambda rule, cut, q: sum(above(r, rule, cut) for r in rows if r["q"] == q)
    n, k = sum(r["q"] for r in rows), -1
    while sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 2)) <= level:
        k += 1
    cuts, best, chosen = {}, 0, {}
    for back in range(1, 11):
        for rule, cs in grid.items():
            if back > len(cs):
                continue
            if hits(rule, cs[-back], 0) == (hits(rule, cs[1 - back], 0) if back > 1 else 0):
                continue
            cuts[rule] = cs[-back]
            good, bad = (sum(any(above(r, x, c) for x, c in cuts.items()) for r in rows if r["q"] == q) for q in (1, 0))
            if good > k:
                return {(None, x): c for x, c in chosen.items()}
            if bad - good > best:
                best, chosen = bad - good, dict(cuts)
    return {(None, x): c for x, c in chosen.items()}


def test_kk_and_shards(spark):
    place, sums = sharding.kk_difference([[w, 0] for w in (8, 7, 6, 5, 4)], 2)
    assert sorted(sums) == [14, 16] and len(place) == 5
    texts = ["t" * (i % 97) for i in range(1500)] + [None, None, ""]
    got = sharding.shard_by_bytes(docs(spark, texts)).collect()
    shard_of, by = {}, {}
    for r in got:
        t = texts[r["doc_id"]]
        assert shard_of.setdefault(t, r["shard"]) == r["shard"]
        assert r["size"] == len(t or "") + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        by.setdefault(r["shard"], []).append(r)
    load = [sum(r["size"] for r in rows) for rows in by.values()]
    assert len(by) == 8 and max(load) - min(load) <= 200
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sharding.shard_by_bytes(docs(spark, texts).limit(0)).count() == 0


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")]), (703, [float("inf")]), (704, [2.0]), (0, x[0].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(d, F.col("vec_id") % 20 == 0).collect())
    full = {i: [math.floor(64 * e) for e in v] + [0] * (16 - len(v)) for i, v in [*enumerate(x.tolist()), (704, [2.0])]}
    want = []
    for q in [i for i in full if i % 20 == 0]:
        s = sorted((-sum(a * b for a, b in zip(full[q], v)), i) for i, v in full.items() if i != q)[:20]
        want += [(q, n + 1, i, -sc) for n, (sc, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.exact_top_k(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chat_round_trip_and_order(spark):
    rows = [
        (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\n & &lt;| &amp;"),
        (1, 1, "user", None),
        (2, 1, "assistant", "x"),
        (3, 1, "user", "x"),
        (None, 1, "user", "a"),
        (None, None, None, "b<"),
        (4, 1, "us\ner", "|>"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(d).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    for c, r in got.items():
        want = sorted(((t is not None, t or 0, ro or "", tx or "") for cc, t, ro, tx in rows if cc == c))
        assert [(b["role"], b["text"]) for b in r["back"]] == [w[2:] for w in want]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["first_bad_turn"] == 0
    assert not got[3]["valid"] and got[3]["first_bad_turn"] == 1
    assert chat.format_chats(d.limit(0)).count() == 0


def test_line_runs_levels_and_batches(spark):
    long = "this line is long enough to count"
    texts = [f"{long}\nown {i}\n  {long.upper()} " for i in range(5)] + [None, "", "short\nshort"] + ["twice only, but long enough"] * 2
    d = docs(spark, texts)
    runs = line_runs.LineRuns(spark, fanout=2)
    for i in range(5):
        runs.add(d.filter((F.col("doc_id") % 5) == i))
    assert sum(map(len, runs.levels)) == 2 and not runs.levels[1]
    got = {r["doc_id"]: r for r in line_runs.dedup_lines(d, runs).collect()}
    for i in range(4):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (3, 2, f"own {i}")
    assert got[4]["n_dropped"] == 0 and got[5]["n_lines"] == 1 and got[5]["kept_text"] == ""
    assert got[7]["kept_text"] == "short\nshort" and got[8]["n_dropped"] == 0
    for n in (1, 3):
        same = {r["doc_id"]: r["kept_text"] for r in line_runs.dedup_table(d, batches=n).collect()}
        assert same == {i: r["kept_text"] for i, r in got.items()}


def test_line_dedup_null_and_repeated_ids(spark):
    x = "this line is long enough to count"
    texts = [f"{x}\nfirst of its own", "a line of one text alone\nsecond", f"{x}\nthird", f"one more single line here\n{x}", f"{x}\nlast"]
    d = docs(spark, texts, ids=[None, None, 7, 7, 9])
    want = ["first of its own", texts[1], "third", "one more single line here", texts[4]]
    for n in (1, 3):
        got = {r["_key"]: r for r in line_runs.dedup_table(d, batches=n).collect()}
        assert [got[i]["kept_text"] for i in range(5)] == want
        assert [got[i]["n_dropped"] for i in range(5)] == [1, 0, 1, 1, 0]


def _kn(texts, order):
    """The model by plain dictionaries: p(char | context)."""
    from collections import Counter, defaultdict

    pad = perplexity.PAD * (order - 1)
    grams = Counter(p[i - order + 1 : i + 1] for t in texts for p in [pad + perplexity.plain(t)] for i in range(order - 1, len(p)))
    tables = {order: grams}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    model = {}
    for n, t in tables.items():
        n1, n2, n3, n4 = (sum(c == i for c in t.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d = [min(max(x, 0.05), m + 1 - 0.05) for m, x in enumerate(d)]
        total, off = defaultdict(int), defaultdict(float)
        for g, c in t.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        model[n] = (t, d, total, off)
    v = len(tables[1]) + 1

    def p(ctx, ch):
        n = len(ctx) + 1
        low = p(ctx[1:], ch) if n > 1 else 1 / v
        t, d, total, off = model[n]
        if not total[ctx]:
            return low
        c = t.get(ctx + ch, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total[ctx] + off[ctx] / total[ctx] * low

    return p


def test_perplexity_brute_force(spark, monkeypatch):
    train = [BASE, BASE + " again", "pack my box with five dozen liquor jugs", "Ünï cödé 漢字"]
    model = perplexity.kneser_ney(perplexity.count_grams(docs(spark, train))).cache()
    texts = ["the dozen foxes jump", "zzz qqq 漢", BASE, "", None, " \n"]
    p, n = _kn(train, perplexity.ORDER), perplexity.ORDER - 1
    for rows in (perplexity.SHARD_ROWS, 150):  # one shard, then several
        monkeypatch.setattr(perplexity, "SHARD_ROWS", rows)
        for r in perplexity.score_documents(docs(spark, texts), model).collect():
            t = perplexity.PAD * n + perplexity.plain(texts[r["doc_id"]])
            want = [math.log(p(t[i - n : i], t[i])) for i in range(n, len(t))]
            assert r["n_chars"] == len(want)
            if want:
                assert r["log_perplexity"] == pytest.approx(-sum(want) / len(want), rel=1e-5)
            else:
                assert r["log_perplexity"] is None


def test_classifier_held_out(spark):
    rng = np.random.default_rng(7)
    words = BASE.split()
    good = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    junk = ["".join(rng.choice(list("qzx#$%0"), 200)) for _ in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in perplexity.classify(docs(spark, [*good, *junk, None]), labels).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 71))




def test_classifier_cutoff_is_the_out_of_sample_quantile(spark):
    rng, n = np.random.default_rng(9), perplexity.ORDER - 1
    words = BASE.split()
    good = [" ".join(rng.choice(words, 30)) for _ in range(24)]
    bad = ["".join(rng.permutation(list(w))) if rng.random() < 0.3 else w for w in rng.choice(words, 300)]
    texts = [*good, *(" ".join(bad[i : i + 30]) for i in range(0, 300, 30))]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    fold = {r["doc_id"]: r["f"] for r in d.select("doc_id", perplexity.fold_of(F.col("text")).alias("f")).collect()}
    p = {f: _kn([t for i, t in enumerate(good) if fold[i] != f], perplexity.ORDER) for f in (0, 1)}
    p[None] = _kn(good, perplexity.ORDER)

    def score(i, f):
        t = perplexity.PAD * n + perplexity.plain(texts[i])
        return -np.mean([math.log(p[f](t[j - n : j], t[j])) for j in range(n, len(t))])

    want = [score(i, None) for i in range(len(texts))]
    high = lambda x: (math.floor(1000 * sorted(x)[math.ceil(0.99 * 24) - 1]) + 1) / 1000
    cutoff = high([score(i, fold[i]) for i in range(24)])
    got = {r["doc_id"]: r for r in perplexity.classify(d, labels).collect()}
    for i, r in got.items():
        assert r["perplexity"] == pytest.approx(math.exp(want[i]), rel=1e-4)
        assert r["cutoff"] == pytest.approx(math.exp(cutoff), rel=2e-3) and r["kept"] == (r["perplexity"] <= r["cutoff"])
    assert all(got[i]["kept"] for i in range(24)) and not any(got[i]["kept"] for i in range(24, 34))
    assert any(want[i] <= high(want[:24]) + math.log(1.5) for i in range(24, 34))  # 1.5 times the quantile in sample keeps these


class UnwalkedDict(dict):
    """Counts the times all its keys were taken."""

    walks = 0

    def keys(self):
        self.walks += 1
        return super().keys()


def test_new_chunks_without_walking_the_memo():
    plain = framed.ChunkedTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    plain.memo = memo = UnwalkedDict()
    texts = ["one two\nthree", "two  three four", None, "", "one\n\nfive two"]
    first = plain.encode(texts)
    assert first == plain.encode(texts) and memo and memo.walks == 0
    assert first == [b"" if not t else plain.raw([t])[0] for t in texts]
    merged = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    merged.memo.number = number = UnwalkedDict()
    ids, at = merged.encode(texts)
    again, at2 = merged.encode(texts)
    assert number and number.walks == 0 and ids.tolist() == again.tolist() and at.tolist() == at2.tolist()


def test_perplexity_model_has_few_partitions(spark, monkeypatch):
    """As many partitions as its rows need, however many a shuffle has; the rows are the same."""
    docs = spark.createDataFrame([(i, f"some text of number {i} and {i * i}") for i in range(30)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = perplexity.count_grams(docs)
        model = perplexity.kneser_ney(counts)
        assert model.rdd.getNumPartitions() == 2 * perplexity.ORDER + 1
        monkeypatch.setattr(perplexity, "PART_ROWS", 5)
        many = perplexity.kneser_ney(counts)
        assert many.rdd.getNumPartitions() > 2 * perplexity.ORDER + 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    rounded = [sorted((r["n"], r["gram"], round(r["logp"], 9)) for r in m.collect()) for m in (model, many)]
    assert rounded[0] == rounded[1]
