"""Hard negatives, divergence of sources and stored ids against brute force and small cases of their own."""

import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from whereabouts.llm import divergence, id_store, negatives

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
BIG = 2**53 + 1


def brute_negatives(rows, positives=5, negatives_=10):
    """Rows are (id, label, vector); as the docstring of hard_negatives has it, in Python integers."""
    good = {(i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    good = [(i, l, [math.floor(Fraction(x) * 256) for x in v]) for i, l, v in good]
    score = lambda a, b: max(-(2**62), min(2**62, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, l, v in good:
        if i % 100:
            continue
        near = sorted((-score(v, w), j) for j, m, w in good if m == l and j != i)[:positives]
        for p, j in near:
            far = sorted((-score(v, w), k) for k, m, w in good if m != l)
            inside = [(s, k) for s, k in far if 30 * -p <= 100 * -s <= 90 * -p][:negatives_]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1), "tag": F.lit(None), "pack": F.lit(2), "x": F.lit(0)})
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **more).collect())


def test_negatives(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 64)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "LANE", 500)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + 0.3 * rng.normal(size=12)).tolist()) for i in range(1500)]
    rows += [(2000 + i, i % 2, centres[0].tolist()) for i in range(300)]  # a group of equal vectors: ties
    rows += rows[:120]  # exact repeats
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 300


def test_negatives_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [
        (100, 1, v), (1, 1, v), (2, 1, [0.4, -0.2, 0.9]), (3, 2, [0.3, -0.1, 0.5]), (4, 2, None), (5, None, v), (None, 2, v), (6, 2, [0.1, None, 1.0]), (7, 2, [0.1, float("nan"), 1.0]),
        (8, 2, [float("inf"), 0.0, 0.0]), (200, 2, [0.0, 0.0, 0.0]), (9, 2, []), (10, 3, [0.2]), (11, 3, [0.2, 0.1, 0.3, 9.0]), (100, 2, [0.1, 0.1, 0.4]), (300, 1, [-9.0, 0.0, 0.0]), (BIG, 1, v), (BIG + 2, 2, [0.3, -0.1, 0.6]),
    ]
    got = mined(spark, rows)
    assert got == brute_negatives(rows)
    assert {r[1] for r in got if r[0] == 100} >= {1, BIG} and BIG + 2 in {r[3] for r in got}
    huge = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 2.0]), (2, 1, [1e12, 2.0]), (3, 2, [1e11, 1.0]), (4, 2, [1e306, 0.0]), (5, 2, [5e9, 1.0]), (100, 1, [3e5, 1e-3]), (200, 3, [1e306, -1.0])]
    assert mined(spark, huge) == brute_negatives(huge)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, v)]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6), st.floats(1e-3, 1e6))
def test_bounds_hold(seed, d, size):
    """No score leaves the bounds of its pair, nor of its tiles."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, d)) * size * 10.0 ** rng.integers(-2, 3, size=(40, 1))
    x[5], x[6] = x[4], -x[4]
    q = negatives.quantized(x, 256)
    refs = rng.normal(size=(4, d))
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)
    norms, angles = negatives.measures(x, refs, 256)
    exact = negatives.scored(q, float(norms.max()), q, float(norms.max()))
    cut = lambda v: max(-(2**62), min(2**62, v))
    assert exact.tolist() == [[cut(sum(int(a) * int(b) for a, b in zip(u, v))) for v in q.tolist()] for u in q.tolist()]
    least, most = negatives.cosine_gap(angles[:, None], angles[:, None], angles[None], angles[None])
    low, high = negatives.score_bounds(least, most, norms[:, None] * norms, norms[:, None] * norms)
    assert (low <= exact).all() and (exact <= high).all()
    a, b = slice(0, 15), slice(15, 40)
    least, most = negatives.cosine_gap(angles[a].min(0), angles[a].max(0), angles[b].min(0), angles[b].max(0))
    low, high = negatives.score_bounds(least, most, norms[a].min() * norms[b].min(), norms[a].max() * norms[b].max())
    assert low <= exact[a, b].min() and exact[a, b].max() <= high


def brute_divergence(rows, least=3, top=200):
    text = lambda x: x or ""
    n, held = Counter(), Counter()
    for words, lang, source in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text(words))
        terms = "".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in lower).split(" ")
        terms = [t for t in terms if t]
        n.update((text(lang), text(source), t) for t in terms)
        held.update((text(lang), t) for t in set(terms))
    out = []
    for lang in {text(r[1]) for r in rows}:
        kept = sorted(t for g, t in held if g == lang and held[g, t] >= least)
        groups = sorted({text(s) for _, g, s in rows if text(g) == lang})
        count = {s: [n[lang, s, t] for t in kept] for s in groups}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(kept))
        p = {s: [share(c, sum(count[s])) for c in count[s]] for s in groups}
        whole = [sum(count[s][i] for s in groups) for i in range(len(kept))]
        q = [share(c, sum(whole)) for c in whole]
        f = lambda a, b: (a - b) * (a - b) // b
        for s in groups:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in groups if o != s]
            terms = [(f(a, b), t) for a, b, c, t in zip(p[s], q, count[s], kept) if c and a > b]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda r: (-r[0], r[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def audited(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"c": F.lit(1), "p": F.lit("x"), "term": F.lit("y"), "item": F.lit(0), "value": F.lit(None)})
    return sorted(tuple(r) for r in divergence.divergence(df, **more).collect())


def test_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 300)
    monkeypatch.setattr(divergence, "PAIRS", 100)
    monkeypatch.setattr(divergence, "PIECE", 50)
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in ("Ab", "é", "日本", "z", "ÉA") for b in "abcdefghijklmnopqrst"]
    rows = []
    for _ in range(300):
        words = rng.choice(vocabulary, size=rng.integers(0, 60), p=(w := 1 / np.arange(1, 101)) / w.sum())
        rows.append((" ".join(words) + str(rng.choice(["", "\n", "-x", "3", " \u0085"])), str(rng.choice(["en", "de"])), f"s{min(rng.integers(12), rng.integers(12))}"))
    assert audited(spark, rows, top=15) == brute_divergence(rows, top=15)


def test_divergence_odd_rows(spark):
    rows = [
        (None, None, None), ("", "", ""), ("alone", "fr", "a"), (None, "fr", "b"), ("Word word WORD", "en", None), ("word x", "en", "a"), ("word x", "en", "a"), ("x " * 50_000, "en", "b"),
        ("KK İ", "en", "b"), ("kK İ", "en", "c"), ("kK İ\x00\x1f\x7f", "en", "c"), ("123 ...", "en", "d"), (None, "xx", "only"),
    ]
    assert audited(spark, rows) == brute_divergence(rows)
    assert audited(spark, []) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6)), max_size=60), st.integers(1, 5))
def test_skyband(rows, k):
    got = divergence.skyband(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), k)
    beats = lambda i, j: rows[i][0] >= rows[j][0] and rows[i][1] <= rows[j][1] and i < j
    assert sorted(got.tolist()) == [j for j in range(len(rows)) if sum(beats(i, j) for i in range(len(rows))) < k]


ODD = [
    (3, "word é 日本 😀", "x"), (3, "word é 日本 😀", "y"), (3, "other", None), (None, "no id", "x"), (None, None, None), (1, None, "x"), (2, "", "x"), (9, "long text, " * 30_000, "x"),
    (BIG, "<|endoftext|> it's", "x"), (BIG + 2, "a", "x"), (-5, "first", "x"),
]


def stored_by_hand(rows):
    library = Tokenizer.from_file(BPE)
    return [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in rows]


def test_id_store(spark, tmp_path):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, ids string").withColumns({"part": F.lit("a"), "offset": F.lit(1), "key": F.lit(2), "row": F.lit(3), "n": F.lit(None)})
    got = id_store.round_trip(docs, BPE).collect()
    want = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in stored_by_hand(ODD)]
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.concatenate(([0], np.cumsum([r.n_tokens for r in order])[:-1])).tolist()
    keys = [(r.doc_id is None, r.doc_id or 0) for r in order]
    assert keys == sorted(keys)
    assert id_store.round_trip(docs.limit(0), BPE).count() == 0


def test_id_store_files(spark, tmp_path):
    """Several files and stripes; ids come back whole; a filter on doc_id reaches the files."""
    rows = [(i, f"document {i} " + "some words of it " * (i % 40)) for i in range(0, 20_000, 2)]
    path = str(tmp_path / "ids")
    id_store.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, BPE, part_bytes=1 << 19, stripe=1 << 16)
    files = id_store.read_ids(spark, path)
    by_hand = dict(stored_by_hand(rows[100:140]))
    got = {r.doc_id: r.ids for r in id_store.of_documents(files, list(by_hand)).collect()}
    assert got == by_hand
    assert id_store.of_documents(files, [201, 5, -1]).count() == 0
    assert "PushedFilters: [In(doc_id" in files.where(F.col("doc_id").isin([200, 400]))._jdf.queryExecution().toString()
    assert files.select("part").distinct().count() > 2
    orc = spark._jvm.org.apache.orc
    conf = spark._jsc.hadoopConfiguration()
    paths = [r[0] for r in files.select(F.input_file_name()).distinct().collect()]
    for name in paths:
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(name), orc.OrcFile.readerOptions(conf))
        assert reader.getStripes().size() > 1 and reader.getRowIndexStride() == id_store.STRIDE
        assert reader.getContentLength() < 2.2 * 4 * sum(files.where(F.input_file_name() == name).agg(F.sum("n")).first()) / 4
    stats = [orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(p), orc.OrcFile.readerOptions(conf)).getStatistics()[4] for p in paths]
    ranges = sorted((s.getMinimum(), s.getMaximum()) for s in stats)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=8))
def test_crc_of_parts(parts):
    assert id_store.crc_of([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("name", ["op11_negatives", "op12_divergence", "op13_id_store"])
def test_registered(name):
    from whereabouts.llm import queries

    assert name in queries.QUERIES and (name in queries.ORACLES) == (name != "op13_id_store")
