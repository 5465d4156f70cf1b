"""Which sources and terms a source diverges by: exact chi-square-like figures, top terms by dominance skybands."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, saved

UNIT = 1_000_000_000
HELD = 400_000  # entries that a task counts, or rows that it gathers, before it hands them on or drops some
PIECE = 1 << 20  # bytes of text that are cut into terms at a time
SALTS = 16
PAIRS = 1 << 21  # pairs of sources that numpy works on at a time
# A term is a run of ASCII letters and of bytes from 128 on; A-Z become a-z, all else parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes):
    """The terms of a text, a list for each piece of it."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # go on to the next byte that parts terms
            while end < len(text) and LETTERS[text[end]] != 32:
                end += 1
        yield text[at:end].translate(LETTERS).split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, c, d``: occurrences, and documents that hold the term; several rows for one term and group,
    since each task hands on what it has counted. ``term`` is binary, in UTF-8."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emit():
            columns = ([], [], [], [], [])
            for (lang, source), (n, d) in held.items():
                for out, values in zip(columns, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), (d[t] for t in n))):
                    out.extend(values)
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "c", "d"])

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, met = len(n), set()
                for terms in terms_of(text):
                    n.update(terms)
                    met.update(terms)
                d.update(met)
                size += len(n) - before
                if size >= HELD:
                    yield emit()
                    held.clear()
                    size = 0
        yield emit()

    ready(docs.sparkSession)
    texts = _groups_of(docs).select("lang", "source", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "lang string, source string, term binary, c long, d long")


def _groups_of(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), F.col("text").cast("string").alias("text"))


def share(count: str, total: str, terms: str) -> str:
    """SQL of the smoothed share of a count in units of 1e-9, exact beyond what a bigint holds."""
    return f"1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * {UNIT}) div ({total} + {terms})"


def figure(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _met(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def meetings(valued: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for each two sources what the terms that both hold add to the sum over all terms,
    beside what each alone would add.

    The rows of a term come one after another; pairs of sources are summed in place, and only sums leave the task.
    """
    names = ["lang", "source", "term", "p", "z"]

    def run(batches):
        codes: dict[tuple[str, str], int] = {}
        sums: dict[int, int] = {}

        def add(rows: pd.DataFrame) -> None:
            if not len(rows):
                return
            own = np.array([codes.setdefault(k, len(codes)) for k in zip(rows["lang"], rows["source"])], dtype=np.int64)
            p, z = rows["p"].to_numpy(np.int64), rows["z"].to_numpy(np.int64)
            starts = np.flatnonzero(_turns(rows))
            sizes = np.diff(np.append(starts, len(rows)))
            first, many = np.repeat(starts, sizes), np.repeat(sizes, sizes)
            done = np.concatenate(([0], np.cumsum(many)))
            at = 0
            while at < len(rows):
                end = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
                i = np.repeat(np.arange(at, end), many[at:end])
                j = np.arange(done[at], done[end]) - done[i] + first[i]
                value = _met(p[i], p[j]) - _met(p[i], z[j]) - _met(z[i], p[j]) + _met(z[i], z[j])
                keys, which = np.unique((own[i] << 32) | own[j], return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, which, value)
                for key, n in zip(keys.tolist(), total.tolist()):
                    sums[key] = sums.get(key, 0) + n
                at = end

        def emit() -> pd.DataFrame:
            group = list(codes)
            rows = [(*group[k >> 32], group[k & 0xFFFFFFFF][1], n) for k, n in sums.items() if k >> 32 != k & 0xFFFFFFFF]
            codes.clear()
            sums.clear()
            return pd.DataFrame(rows, columns=["lang", "source", "item", "value"])

        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = int(np.flatnonzero(_turns(rows))[-1]) if len(rows) else 0
            add(rows[:last])
            rest = rows[last:]
            if len(sums) > HELD:
                yield emit()
        if rest is not None:
            add(rest)
        yield emit()

    rows = valued.select(*names).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return rows.mapInPandas(run, "lang string, source string, item string, value long")


def _turns(rows: pd.DataFrame) -> np.ndarray:
    """Where another term begins."""
    if not len(rows):
        return np.zeros(0, bool)
    lang, term = rows["lang"].to_numpy(), rows["term"].to_numpy()
    return np.concatenate(([True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])))


def skyband(count: np.ndarray, whole: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that fewer than ``k`` others dominate; rows come in the order of their terms.

    One row dominates another with a count as high or higher, a count in the language as low or lower, and an earlier term.
    Of rows with equal counts only the first ``k`` are left, all at once. In order of falling counts every dominator of the rest
    comes first, and dominance carries over, so the rows kept so far decide.
    """
    order = np.lexsort((whole, -count))
    turns = np.flatnonzero(np.concatenate(([True], (np.diff(count[order]) != 0) | (np.diff(whole[order]) != 0)))[: len(order)])
    within = np.arange(len(order)) - np.repeat(turns, np.diff(np.append(turns, len(order))))
    order = order[within < k]
    kept = np.empty(len(order), np.int64)
    low = np.empty(len(order), np.int64)
    n = 0
    for row, own in zip(order.tolist(), whole[order].tolist()):
        if n < k or np.count_nonzero((low[:n] <= own) & (kept[:n] < row)) < k:
            kept[n], low[n] = row, own
            n += 1
    return np.sort(kept[:n])


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """The rows that fewer than ``k`` rows of the same group and partition dominate."""
    names = ["lang", "source", "term", "c", "lc", "p", "q"]
    kinds = "lang string, source string, term binary, c long, lc long, p long, q long"

    def run(batches):
        def reduced(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts, ignore_index=True)
            count, whole = rows["c"].to_numpy(np.int64), rows["lc"].to_numpy(np.int64)
            found = [own[skyband(count[own], whole[own], k)] for own in rows.groupby(["lang", "source"], sort=False).indices.values()]
            return rows.iloc[np.sort(np.concatenate(found))] if found else rows

        held: list[pd.DataFrame] = []
        size = left = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size - left >= HELD:
                held = [reduced(held)]
                size = left = len(held[0])
                if left >= HELD:  # very many groups: no more is kept of what came so far
                    yield held.pop()
                    size = left = 0
        if held:
            yield reduced(held)

    return rows.select(*names).sortWithinPartitions("term").mapInPandas(run, kinds)


def divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of ``docs (text, lang, source)``.

    Terms are runs of ASCII letters (A-Z as a-z) and of characters beyond ASCII; each language keeps those in ``least`` of its
    rows. With N the count of kept terms in a group or language and V their number, a term has p = 1 + floor(1e9 * (count + 1) /
    (N + V)), and two shares differ by f = floor((p - q)**2 / q). Part ``pair``: every other source of the language, with f
    against it summed over all kept terms. Part ``term``: terms with p above the language's q, the ``top`` highest f.

    Terms are counted in Python across each task and once more after one shuffle by (lang, term). What two sources share is
    summed per term; all other terms come in by how often each count occurs, so zeros are never made rows. The rank of terms goes over
    skybands: f rises with the count and falls with the language's, so a term that ``top`` others dominate can't be among the
    first ``top``; each task drops those, salted merges drop more, and the rest is ranked exactly.

    The sources that hold a term stay together while it is worked on; their number squared is that of the result's pairs.
    Null text, lang and source are ''. Rows that repeat count each. A language without kept terms has pairs of value 0. Other
    columns are not read. No rows: no rows.
    """
    counts = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    own = Window.partitionBy("lang", "term")
    kept = counts.select(
        "lang", "source", "term", "c", F.sum("c").over(own).alias("lc"), F.sum("d").over(own).alias("held"), (F.row_number().over(own.orderBy("source")) == 1).alias("first")
    )
    kept = saved(kept.where(F.col("held") >= least).drop("held"))
    of_lang = kept.groupBy("lang").agg(F.sum("c").alias("whole"), F.sum(F.col("first").cast("long")).alias("v"))
    groups = _groups_of(docs).select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("c").alias("n")), ["lang", "source"], "left")
    groups = saved(groups.join(of_lang, "lang").fillna(0, ["n"]).withColumn("z", F.expr(share("0", "n", "v"))))
    valued = kept.join(groups.select("lang", "source", "n", "v", "whole", "z"), ["lang", "source"])
    valued = valued.withColumns({"p": F.expr(share("c", "n", "v")), "q": F.expr(share("lc", "whole", "v"))})

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("z2"))
    rest = groups.join(other, "lang").where("source <> item").selectExpr("lang", "source", "item", f"v * ({figure('z', 'z2')}) AS value")
    often = valued.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("m"))
    beside = often.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.expr(f"m * (({figure('p', 'z2')}) - ({figure('z', 'z2')}))")).alias("there"), F.sum(F.expr(f"m * (({figure('z2', 'p')}) - ({figure('z2', 'z')}))")).alias("here")
    )
    beside = beside.select("lang", F.inline(F.expr("array(struct(source, item, there AS value), struct(item AS source, source AS item, here AS value))")))
    all_groups = _groups_of(docs).select("lang", "source").distinct()
    bare = all_groups.join(all_groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    sums = bare.unionByName(rest).unionByName(beside).unionByName(meetings(valued)).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))

    band = skybands(valued.where("p > q"), top)
    band = skybands(band.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS))), top)
    terms = band.select("lang", "source", F.expr("CAST(term AS string)").alias("item"), F.expr(figure("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(sums, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
  t AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
  g AS (SELECT DISTINCT lang, source FROM d),
  v AS (SELECT lang, count(*) AS v, sum(lc) AS n FROM kept GROUP BY lang),
  c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
  n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
  p AS (SELECT n.lang, n.source, kept.term, coalesce(c.c, 0) AS c,
      1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + v.v) AS p, 1 + (1000000000::HUGEINT * (kept.lc + 1)) // (v.n + v.v) AS q
    FROM n JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
  summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g AS o ON g.lang = o.lang AND g.source <> o.source
    LEFT JOIN summed AS s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
