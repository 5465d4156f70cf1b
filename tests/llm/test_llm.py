"""The operators for training-data corpora against brute force, exact round trips and small cases of their own."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from whereabouts.llm import ann, components, fingerprint, html_text, language_id, line_dedup, packing, pieces, quality, simhash, toxicity
from whereabouts.llm.common import held_out

BPE, PIECES = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string"
ODD = [
    (1, None, None, "x"), (2, "", "en", "x"), (3, "word", "en", None), (3, "word", "en", None), (4, "a  b\t\n\n c ", "de", "x"),
    (None, "no id here", "en", "x"), (5, "long " * 60_000, "en", "x"), (6, "word", None, "x"), (7, "<|endoftext|> é 日本 😀 ▁ it's", "fr", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_packing(docs, odd, none):
    library = Tokenizer.from_file(BPE)
    got = packing.packed(docs.unionByName(odd.drop("score"), allowMissingColumns=True), BPE).toPandas()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(r[0], r[1]) for r in ODD]
    want = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = [tuple(None if pd.isna(v) else int(v) for v in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert list(bin_.offset) == [0, *np.cumsum(bin_.length)[:-1]] and bin_.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2
    assert packing.packed(none, BPE).count() == 0


def test_swaps_empty_bins():
    random.seed(4)
    for _ in range(30):
        lengths = np.array([random.choice([5, 7, 9, 11, 13, 30, 41, 60]) for _ in range(80)])
        bins = [[i] for i in range(80)]  # as bad as can be
        better = packing.improve(lengths, bins, 100)
        assert sorted(x for b in better for x in b) == list(range(80)) and max(lengths[b].sum() for b in better) <= 100
        assert len(better) <= -(-lengths.sum() // 100) + 3


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16))
    v[200:320] = v[7]  # a third of all rows is one vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0]), (None, [1.0] * 16), (3, [float(x) for x in v[3]])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got.query_id) == set(range(0, 400, 50))
    for q, mine in got.sort_values("rank").groupby("query_id"):
        s = ann.cosine(v[q], v)
        best = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and list(mine.vec_id) == best and np.allclose(mine.score, s[best], atol=1e-12)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few).collect()] == [(0, 1, 1)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_early_abandonment_keeps_the_nearest():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 64)) + rng.normal(size=(10, 64))[rng.integers(0, 10, 3000)]
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    rows = rows @ ann.rotation(64)
    hits = sum(len(set(np.argsort(-(rows @ rows[q]))[:6]) & set(ann.scan(rows[q], rows, 6))) for q in range(50))
    assert hits >= 0.95 * 300
    assert len(ann.scan(rows[0], rows, 6)) < 600


def _long_line(n, seed):
    random.seed(seed)
    return " ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_line_dedup(spark, odd, none):
    p, q, r = _long_line(60, 1), _long_line(25, 2) + "\n" + _long_line(30, 3), _long_line(12, 4)
    texts = {1: f"own one\n{p}\nend", 2: f"{q}\nown two", 3: f"own three\n{p.upper()}\n{q}\ntail", 4: f"{r}\nx", 5: f"{r}\ny", 6: f"a\n{p}\nb\n{p}\nc", 7: p, 8: "keeps\n\n  all "}
    rows = spark.createDataFrame([(k, v, "text") for k, v in texts.items()] + [(8, texts[8], "text")], "doc_id long, text string, lines_removed string")
    got = {(x.doc_id, x.text, x.lines_removed) for x in line_dedup.dedup_lines(rows).collect()}
    assert got == {
        (1, texts[1], 0), (2, texts[2], 0), (3, "own three\ntail", 3), (4, texts[4], 0), (5, texts[5], 0), (6, "a\nb\nc", 2), (7, "", 1), (8, texts[8], 0),
    }
    back = line_dedup.dedup_lines(odd)
    assert back.columns == ["doc_id", "text", "lang", "score", "lines_removed"]
    assert sorted(map(str, [tuple(x)[:4] for x in back.collect()])) == sorted(map(str, ODD))
    assert line_dedup.dedup_lines(none).count() == 0


def test_every_long_repeat_holds_a_fingerprint():
    random.seed(9)
    for _ in range(200):
        line = lambda: " ".join(["w"] * random.randint(0, 25)) + str(random.random())
        run = [line() for _ in range(random.randint(1, 12))]
        if sum(len(x.split()) for x in run) < 40:
            continue
        marks = []
        for _ in range(2):
            head = [line() for _ in range(random.randint(0, 5))]
            hashes, words = line_dedup.line_hashes("\n".join(head + run + [line() for _ in range(random.randint(0, 5))]))
            found, ends = line_dedup.grams(hashes, words, 20)
            starts = line_dedup.fingerprints(hashes, words, 20, 40)
            marks.append({int(found[s]) for s in starts if s >= len(head) and ends[s] <= len(head) + len(run)})
        assert marks[0] & marks[1]


def _plain_simhash(text):
    words = (text or "").encode().lower().split()
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, odd, none):
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = simhash.near_duplicates(rows, tile=16).toPandas()
    texts = [(r.doc_id, _plain_simhash(r.text)) for r in rows.collect()]
    assert sorted((str(a), f"{b:016x}") for a, b in texts) == sorted((str(None if pd.isna(a) else int(a)), b) for a, b in zip(got.doc_id, got.fingerprint))
    prints = sorted({b for _, b in texts})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for doc_id, p in texts:
        if doc_id is not None:
            least[find(p)] = min(doc_id, least.get(find(p), doc_id))
    for doc_id, p, c in zip(got.doc_id, got.fingerprint, got.component_id):
        assert (None if pd.isna(c) else c) == least.get(find(int(p, 16)))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(rows.where("doc_id IS NOT NULL"))
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_components(spark):
    random.seed(3)
    links = [(i, i + 1) for i in range(60)] + [(200 + random.randrange(40), 200 + random.randrange(40)) for _ in range(30)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {a: b for a, b in root.items() if a != b}


def test_language(docs, odd, none):
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    mine = got[got.held_out]
    assert (mine.lang == mine.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    back = language_id.identify(odd).toPandas()
    assert len(back) == len(ODD) and set(back[back.doc_id.isin([1, 2])].lang_pred) == {"und"}
    assert language_id.identify(none).count() == 0


@pytest.mark.parametrize("run, column, floor", [(toxicity.toxic, "toxic", 0.85), (quality.quality, "quality", 0.85)])
def test_classifiers(spark, odd, none, run, column, floor):
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    got = run(docs, labels.unionByName(labels)).join(labels, "doc_id").toPandas()
    mine = got[got.held_out]
    assert (mine.predicted == mine[column]).mean() >= floor and mine.score.between(0, 1).all()
    back = run(odd, labels).toPandas()
    assert len(back) == len(ODD) and back.score.between(0, 1).all()
    assert run(odd, labels.limit(0)).count() == len(ODD) and run(none, labels).count() == 0


def test_interactions_are_learned():
    random.seed(5)
    rows = [(a, b, int(a and b)) for _ in range(200) for a in (0, 1) for b in (0, 1)]
    own = np.array([i for i, r in enumerate(rows) for t in (0, 1) if r[t]])
    term = np.array([t for r in rows for t in (0, 1) if r[t]])
    start = {"b": np.zeros(1), "w": np.zeros(2), "v": np.random.default_rng(0).normal(0, 0.1, (2, 4))}
    import pickle

    y = np.array([float(r[2]) for r in rows])
    params = toxicity.fit(start, pickle.dumps((own, term, y)), steps=400)
    margin, _ = toxicity.margins(params, own, term, len(rows))
    assert ((margin > 0) == (y == 1)).all() and float(params["v"][0] @ params["v"][1]) > 0.5


def test_attention_gradient():
    rng = np.random.default_rng(0)
    own, x, y = np.array([0, 0, 1, 2, 2, 2]), rng.normal(size=(6, 5)), np.array([1.0, 0.0, 1.0])
    p = {"mean": np.zeros(5), "spread": np.ones(5), "w": rng.normal(size=(5, 4)), "wb": rng.normal(size=4), "t": rng.normal(size=(4, 3)), "g": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "cb": rng.normal(size=1)}
    loss = lambda: float(np.mean(np.logaddexp(0, (1 - 2 * y) * quality.forward(p, own, x)["logit"])))
    for name, g in quality.gradient(p, own, x, y).items():
        flat = p[name].reshape(-1)
        for i in range(0, flat.size, 3):
            flat[i] += 1e-6
            up = loss()
            flat[i] -= 2e-6
            down = loss()
            flat[i] += 1e-6
            assert abs((up - down) / 2e-6 - g.reshape(-1)[i]) < 1e-5


def test_fingerprints(docs, odd, none):
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id IS NULL OR doc_id <> 3"))
    got = fingerprint.with_next(rows.where("doc_id >= 10"), size=20).toPandas().set_index("doc_id")
    texts = sorted(((r.doc_id, r.text or "") for r in docs.where("doc_id >= 10").collect()), reverse=True)
    assert len(got) == len(texts)
    for (doc_id, text), (_, following) in zip(texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        row = got.loc[doc_id]
        shared = next((i for i, (a, b) in enumerate(zip(text, new)) if a != b), min(len(text), len(new)))
        assert (row.n_chars, row.edited_sha256, row.shared_prefix) == (len(text), hashlib.sha256(new.encode()).hexdigest(), shared)
        assert 0 <= row.near_edited <= 1 and (row.near_next == 1) == (text == following) or len(text) < 100
    assert got.near_edited.mean() > 0.4 > 0.1 > got.near_next.mean()
    everything = fingerprint.with_next(rows).toPandas()
    assert len(everything) == rows.count()
    assert fingerprint.with_next(none).count() == 0
    assert everything[everything.doc_id == 1].fingerprint.iloc[0] == everything[everything.doc_id == 2].fingerprint.iloc[0]


def test_common_extensions_in_blocks():
    random.seed(6)
    for _ in range(100):
        a = [random.randrange(3) for _ in range(random.randrange(60))]
        b = a[: random.randrange(61)] + [random.randrange(3) for _ in range(random.randrange(9))]
        shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert fingerprint.shared_start(np.array(a, np.uint32), np.array(b, np.uint32), block=16) == shared
    text = fingerprint.codes_of("".join(random.choice("abcdef ") for _ in range(500)))
    assert fingerprint.fingerprint(text, block=64) == fingerprint.fingerprint(text)


def test_pieces(docs, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows.collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(str, map(tuple, pieces.round_trip(rows, PIECES).collect()))) == sorted(map(str, want))
    back = pieces.decoded(pieces.encoded(odd, PIECES), PIECES)
    assert {r.text for r in back.where("doc_id = 7").collect()} == {ODD[-1][1].replace("▁", " ")}
    assert pieces.round_trip(none, PIECES).count() == 0
    coder, rnd = pieces.coder(PIECES), random.Random(1)
    for _ in range(1500):
        text = "".join(rnd.choice(coder.piece) for _ in range(rnd.randint(1, 10))).replace("▁", rnd.choice((" ", "▁")))
        assert coder.encode([text])[0].tolist() == library.encode(text)
        ids = [rnd.randrange(3, 600) for _ in range(6)]
        assert coder.decode(np.array(ids)) == library.decode(ids)


PAGES = {
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\nd",
    "<ul><li>one<li>two <b>x</b></ul>": "- one\n- two x",
    "<ol start=3><li>a<li>b<ul><li>in</ul></ol>z": "3. a\n4. b\n   - in\n\nz",
    "<table><tr><th>k<td>long cell<tr><td>key2<td>v</table>": "k     long cell\nkey2  v",
    "<div hidden>no</div><p style='display: none'>no</p><style>.h{display:none}</style><i class='a h'>no</i>yes": "yes",
    "<head><title>no</title></head><body>a&amp;b &lt; &#233;<!-- no --><script>if (a</p>b) {}</script> c": "a&b < é c",
    "<pre>a\n  b</pre>c": "a\n  b\n\nc",
    "x<br>y": "x\ny",
    "plain < text": "plain < text",
    "</div>stray</p>": "stray",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_text.visible_text(page) == PAGES[page]


def test_pages_whole(spark):
    pages = spark.createDataFrame([(1, None, "u"), (1, "<p>a", "u"), (2, "<div>" * 20_000 + "deep", "u"), (3, "<" * 50_000, None)], "page_id long, html string, text string")
    got = {(r.page_id, None if r.text is None else r.text[:5]) for r in html_text.extracted(pages).collect()}
    assert got == {(1, None), (1, "a"), (2, "deep"), (3, "<<<<<")}
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    held = docs
    for name, stage in corpus_pipeline.STAGES:
        before, held = held, stage(spark, held, SF)
        if name != "packing":
            assert held.columns == docs.columns
            held = held.cache()
            assert 0 < held.count() <= before.count()
    assert {r.doc_id for r in held.collect()} <= {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() == held.count()
    assert sum(r.length for r in held.collect()) > 0


def test_held_out(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def _brute_dedup(texts, window=40):
    """Units left of each text: every run of whole units that stands earlier goes, by comparison of all places."""
    held = [[(int(h), int(w), int(k)) for h, w, k in zip(*u)] for u in line_dedup.units(texts)]
    flags = [[False] * len(u) for u in held]
    for d, mine in enumerate(held):
        for e in range(d + 1):
            for i in range(len(mine)):
                for j in range(len(held[e])):
                    if e == d and (j >= i or mine[i][2] == held[e][j][2]):
                        continue
                    n = 0
                    while i + n < len(mine) and j + n < len(held[e]) and mine[i + n][0] == held[e][j + n][0]:
                        n += 1
                    if sum(x[1] for x in mine[i : i + n]) >= window:
                        for k in range(i, i + n):
                            flags[d][k] = flags[d][k] or mine[k][1] > 0
    return [[x[0] for x, f in zip(u, g) if x[1] and not f] for u, g in zip(held, flags)]


def test_passages_inside_long_lines(spark):
    passage = _long_line(60, 50)
    texts = [f"{_long_line(300, 51)} {passage} {_long_line(280, 52)}", f"{_long_line(330, 53)} {passage.upper()} {_long_line(310, 54)}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(rows).collect()}
    assert got[0].text == texts[0] and got[1].lines_removed == 1
    left = got[1].text.split()
    assert left[:330] == texts[1].split()[:330] and left[-310:] == texts[1].split()[-310:] and len(left) - 640 <= 11
    for n in range(51, 58):  # every passage of over 50 words
        for seed in range(40):
            p = _long_line(n, 1000 + seed)
            (a, b), marks = (f"{_long_line(30, 2000 + seed)} {p} {_long_line(30, 3000 + seed)}", f"{_long_line(30, 4000 + seed)} {p}"), []
            for hashes, words, _ in line_dedup.units([a, b]):
                marks.append(set(line_dedup.windows(hashes, words, 40)[2].tolist()))
            assert marks[0] & marks[1]


def test_every_earlier_place_counts(spark):
    g = _long_line(25, 60)
    texts = [g]
    for k in range(6):  # one of them at least has g as the least gram of all its windows
        texts += ["\n".join((_long_line(39, 100 + k), g, _long_line(39, 200 + k)))] * 2
    texts += [f"{g}\nown\n{texts[1]}", f"{texts[1]}\n{g}"]  # a second place in a document begins a longer run
    random.seed(8)
    pool = [_long_line(random.choice((3, 12, 25, 39)), 300 + k) for k in range(8)]
    texts += ["\n".join(random.choice(pool) for _ in range(random.randint(1, 7))) for _ in range(25)]
    texts += [" ".join(random.choice(pool) for _ in range(random.randint(1, 5))) for _ in range(15)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in line_dedup.dedup_lines(rows).orderBy("doc_id").collect()]
    words = [sum(int(w) for _, w, _ in zip(*u)) for u in line_dedup.units(got)]
    sizes = {int(h): int(w) for u in line_dedup.units(texts) for h, w, _ in zip(*u)}
    assert words == [sum(sizes[h] for h in left) for left in _brute_dedup(texts)]
    assert all(got[k] == "" for k in range(2, 13, 2))


SHOWN = {
    "<p>a<button>Buy now</button>": "aBuy now",
    "<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math>": "if x=2",
    "<svg> no <defs><text>no</text></defs><g> no <text>drawn</text></g><desc>no</desc></svg>": "drawn",
    "<textarea>\none\ntwo &lt;</textarea>": "one\ntwo <",
    "<select><option>a<option selected>b<option>c</select>": "b",
    "<select><option disabled>pick<option>a<option>b</select>": "a",
    "<select multiple><option>a<option>b</select>": "a b",
    "<dialog>shut</dialog><dialog open>said</dialog>": "said",
    "<p aria-hidden=true>seen": "seen",
    "<style>@media print{.nav{display:none}}</style><p class=nav>seen": "seen",
    "<style>@media print{body{display:none}} @media screen{.x{display:none}} .y{display:none}</style><p>seen<p class=x>no<p class=y>no": "seen",
    "<noscript><style>body{display:none}</style></noscript><body><p>seen": "seen",
    "<style media=print>p{display:none}</style><p>seen": "seen",
    "<table><tbody><td>x</table>": "x",
    "<table><tr><td>a<td>b</tr><td>c<td>d</table>": "a  b\nc  d",
    "<table><tr>text<td>x</tr><tbody><p>block</p><tr><td>y</table>": "text\nblock\nx\ny",
}


@pytest.mark.parametrize("page", SHOWN)
def test_all_that_a_browser_shows(page):
    assert html_text.visible_text(page) == SHOWN[page]


BIG = 2**53 + 1  # an id that a double does not hold


def test_line_dedup_ids_and_columns(spark):
    p = _long_line(60, 400)
    names = ["own_id", "own_key", "row", "run_id", "run_key", "gone", "again", "cut", "gone_", "cut_", "mark", "held"]
    rows = [(BIG, f"a\n{p}"), (BIG + 2, f"b\n{p}"), (None, f"c\n{p}"), (None, "short"), (BIG + 2, "again"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", *names, "lines_removed"]
    back = got.collect()
    assert {(r.doc_id, r.text) for r in back} == {(BIG, f"a\n{p}"), (BIG + 2, "b"), (None, "c"), (None, "short"), (BIG + 2, "again"), (1, None)}
    assert all(r[n] == n for r in back for n in names)


def test_copies_go_as_a_whole():
    """All windows of a text cover what lies between its first and its last word."""
    for text in (_long_line(60, 401), f"\n \u3000\n{_long_line(30, 402)}\n\n\x1c\n {_long_line(5, 403)}  \n{_long_line(20, 404)}\n\t\n", "\n".join(_long_line(3, 405 + k) for k in range(20))):
        hashes, words, lines = next(line_dedup.units([text]))
        edges = np.zeros(len(hashes) + 1, np.int64)
        starts, ends, _ = line_dedup.windows(hashes, words, 40)
        np.add.at(edges, starts, 1)
        np.add.at(edges, ends, -1)
        assert line_dedup.without_words(text) == line_dedup.without(text, np.cumsum(edges[:-1]) > 0, words, lines)


def test_sketch_misses_no_row(spark, monkeypatch):
    """Rows of the table are always true, nulls too; of the others, few are while the sketch is large, and all may be when it is full."""
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), (F.col("id") * 7).alias("b"))
    held = rows.where("coalesce(a, 0) % 3 = 0")
    for bits in (1 << 27, 64):
        monkeypatch.setattr(line_dedup, "SKETCH_BITS", bits)
        got = line_dedup.sketched(rows, held, ["a", "b"])
        assert got.columns == ["a", "b", "may"] and got.count() == 3000
        assert got.where("coalesce(a, 0) % 3 = 0 AND NOT may").count() == 0
        assert bits == 64 or got.where("may").count() < 1010
    assert line_dedup.sketched(rows, held.limit(0), ["a", "b"]).where("may").count() == 0


def test_marks_that_stand_often(spark, monkeypatch):
    """The broadcast of frequent marks and the join of all others tell the same."""
    rows = spark.createDataFrame([(i, m) for i, m in enumerate([1] * 50 + [2] * 3 + [3] * 2 + [4, 5])], "n int, mark long")
    for least in (1, 10, 4096):
        monkeypatch.setattr(line_dedup, "LEAST_HEAVY", least)
        assert sorted(r.n for r in line_dedup.standing_twice(rows, 0).collect()) == list(range(55))


def test_ids_beside_null(spark):
    """A null id in a batch leaves all others as they are."""
    ids = [BIG, BIG + 2, None]
    docs = spark.createDataFrame([(i, "some words of a text here", "en") for i in ids], "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(BIG, 1, 1)], "doc_id long, toxic int, quality int")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))
    runs = {
        "op1": packing.packed(docs, BPE), "op4": simhash.near_duplicates(docs), "op5": language_id.identify(docs), "op6": quality.quality(docs, labels), "op7": fingerprint.with_next(docs),
        "op9": pieces.round_trip(docs, PIECES), "op9e": pieces.decoded(pieces.encoded(docs, PIECES), PIECES), "op10": toxicity.toxic(docs, labels), "op8": html_text.extracted(pages).withColumnRenamed("page_id", "doc_id"),
    }
    for name, found in runs.items():
        got = [r.doc_id for r in found.collect()]
        assert sorted(got, key=str) == sorted(ids, key=str), name
    kept = toxicity.toxic(docs.withColumn("score", F.lit("x")), labels, keep=("doc_id", "score", "lang"))
    assert kept.columns == ["doc_id", "lang", "held_out", "score", "predicted"]


def test_keep_one_keeps_one_row(spark):
    rows = [(None, "a b c d e", 1), (None, "a b c d e", 1), (7, "own text that stays here", 2), (7, "own text that stays here", 2), (7, "a b c d e", 3), (1, "a b c d e", 4), (1, "a b c d e", 5), (None, None, 6), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_ int").withColumn("place_", F.lit(1))
    got = simhash.keep_one(docs).collect()
    assert len(got) == 3 and {(r.doc_id, r.text) for r in got} == {(1, "a b c d e"), (7, "own text that stays here"), (3, "")}
    assert simhash.keep_one(docs.limit(0)).count() == 0 and got[0].asDict().keys() == {"doc_id", "text", "row_", "place_"}


def test_pairs_of_neutral_terms(spark):
    """Labels that depend on a pair of terms, each of which is neutral alone, are learned from texts."""
    random.seed(12)
    rows = []
    for i in range(1600):
        a, b = random.random() < 0.5, random.random() < 0.5
        words = [random.choice(["river", "stone", "cloud", "grass", "light", "field"]) + str(random.randrange(30)) for _ in range(12)]
        rows.append((i, " ".join(words + ["zork"] * a + ["blim"] * b), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxic(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), cut=0.5).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "toxic"]), on="doc_id")
    mine = got[got.held_out]
    assert (mine.predicted == mine.toxic).mean() > 0.97


def test_deep_and_wide_pages():
    import time

    began = time.time()
    assert html_text.visible_text("<table><tr><td>" * 5000 + "x").strip() == "x"
    assert html_text.visible_text("<div>" * 100_000 + "x") == "x"
    assert html_text.visible_text("<b>" * 100_000 + "</i>" * 100_000 + "x") == "x"
    assert html_text.visible_text("<p>" * 50_000 + "x") == "x" and html_text.visible_text("<ul><li>" * 3000 + "x").strip().endswith("x")
    assert time.time() - began < 60
    assert html_text.visible_text("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>") == "ab    c\nd  e  f"
    assert html_text.visible_text("<table><tr><td colspan=x>a<td>b<tr><td>cc<td colspan=0>d</table>") == "a   b\ncc  d"


def test_pieces_of_long_words(monkeypatch):
    """Text without blanks in linear time, and a cache that holds no more than it may, with equal ids."""
    import time

    monkeypatch.setattr(pieces, "KEPT_CHARS", 2000)
    library, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Coder(PIECES)
    random.seed(21)
    texts = ["".join(random.choice("abcdeé日本") for _ in range(random.choice((3, 40, 900)))) + " end" for _ in range(400)]
    for _ in range(2):
        for text, ids in zip(texts, mine.encode(texts)):
            assert ids.tolist() == library.encode(text)
    assert max(map(len, mine.words)) <= pieces.LONG + 1
    began, sizes = time.time(), []
    for n in (500_000, 2_000_000):
        sizes.append(len(mine.encode(["".join(random.choice("abcde") for _ in range(n))])[0]))
    assert time.time() - began < 60 and sizes[1] > 3 * sizes[0]
