"""Line dedup by winnowing over hashes of lines and of pieces of long lines."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, Words, mixed, powers, ready, saved

GRAM_WORDS = 4
WINDOW_WORDS = 40
CUT_WORDS = 6
HEAVY = 16_384  # marks at most that go to all tasks, since they stand often
LEAST_HEAVY = 4096
SKETCH_BITS = 1 << 27  # of the sketch of texts that lose something: 16 MB at most, whatever the number of texts
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
OTHER_BLANKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # fixed values: blanks beyond ASCII
TOKENS = re.compile(r"\S+\s*")


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the number of words of each line; lines are compared without case and blanks at their ends."""
    import xxhash

    lines = (text or "").split("\n")
    hashes = np.array([xxhash.xxh64_intdigest(line.strip().lower()) for line in lines], dtype=np.uint64)
    return hashes, np.array([len(line.split()) for line in lines], dtype=np.int64)


def units(texts: list[str | None]):
    """For each text: the hash, the number of words and the line of each of its units.

    A unit is a line, or a piece of a line of ``CUT_WORDS`` words or more: such a line is cut before the word of the least
    hash of every ``CUT_WORDS`` words in a row, so where it is cut depends on the words there alone, and a passage of n
    words holds the same units wherever it stands, but for at most 2 * CUT_WORDS - 1 words at its ends.
    """
    held, size = [], 0
    for text in texts:
        text = (text or "").lower()
        data = (text if text.isascii() else OTHER_BLANKS.sub(" ", text)).encode()
        if held and size + len(data) > BLOCK:
            yield from _units(held)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield from _units(held)


def _units(texts: list[bytes]):
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    feeds = np.flatnonzero(data == 10)
    found = Words(data, ~BLANKS[data])
    line = np.cumsum(data == 10)[found.starts]
    h = found.hashes(found.starts, found.ends)
    cut = np.ones(len(h), bool)
    cut[1:] = line[1:] != line[:-1]
    many = len(h) - CUT_WORDS + 1
    if many > 0:
        # the least of spans of 1, 2, 4, ... words, two of which cover the words asked for; the later of equals counts
        least, at, size = h, np.arange(len(h)), 1
        while size < CUT_WORDS:
            step = min(size, CUT_WORDS - size)
            less = least[step:] <= least[:-step]
            least, at = np.where(less, least[step:], least[:-step]), np.where(less, at[step:], at[:-step])
            size += step
        cut[at[line[:many] == line[CUT_WORDS - 1 :]]] = True
    first = np.flatnonzero(cut)
    last = np.append(first, len(h))[1:]
    empty = np.ones(len(feeds), bool)
    empty[line] = False
    empty = np.flatnonzero(empty)
    order = np.argsort(np.concatenate((found.starts[first], feeds[empty])), kind="stable")
    hashes = np.concatenate((found.hashes(found.starts[first], found.ends[last - 1]), np.zeros(len(empty), np.uint64)))[order]
    words = np.concatenate((last - first, np.zeros(len(empty), np.int64)))[order]
    line = np.concatenate((line[first], empty))[order]
    tops = np.concatenate(([0], np.cumsum([t.count(b"\n") + 1 for t in texts])))
    bounds = np.searchsorted(line, tops)
    for top, a, b in zip(tops.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        yield hashes[a:b], words[a:b], line[a:b] - top


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of units, from what stands in it alone."""
    up, down = powers(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((hashes + np.uint64(0x9E3779B97F4A7C15)) * up[: len(hashes)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def grams(hashes: np.ndarray, words: np.ndarray, least: int, stops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """From each unit on, the shortest run of units with ``least`` words or more: its hash and its end (0: none).

    ``stops`` has the end of each unit's text, where there are several.
    """
    sums = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(sums, sums[:-1] + least, "left")
    ends = np.where((ends <= (len(hashes) if stops is None else stops)) & (words > 0), ends, 0)
    found = np.zeros(len(hashes), np.uint64)
    live = np.flatnonzero(ends)
    found[live] = run_hashes(hashes, live, ends[live])
    return found, ends


def fingerprints(hashes: np.ndarray, words: np.ndarray, gram: int, window: int, stops: np.ndarray | None = None) -> np.ndarray:
    """Starts of the grams that are least within some window."""
    return np.unique(minima(hashes, words, gram, window, stops)[1])


def minima(hashes: np.ndarray, words: np.ndarray, gram: int, window: int, stops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, the shortest runs of units with ``window`` words or more, and of the least gram in each.

    A window depends on its units alone, so equal runs of that length hold an equal fingerprint at the same place. The least of
    all windows at once comes from the least of spans of 1, 2, 4, ... grams, two of which cover a window; the later of equals counts.
    """
    found, ends = grams(hashes, words, gram, stops)
    until = grams(hashes, words, window, stops)[1]
    live = np.flatnonzero(ends)
    starts = np.flatnonzero(until)
    if not len(starts):
        return starts, starts
    value, last = found[live], ends[live]
    low, high = np.searchsorted(live, starts), np.searchsorted(last, until[starts], "right")
    step = np.frexp((high - low).astype(float))[1] - 1  # the largest power of two that fits
    least = np.arange(len(live))
    chosen = np.empty(len(starts), np.int64)
    for k in range(int(step.max()) + 1):
        now = np.flatnonzero(step == k)
        left, right = least[low[now]], least[high[now] - (1 << k)]
        chosen[now] = np.where(value[right] <= value[left], right, left)
        if len(least) <= 1 << k:
            break
        left, right = least[: -(1 << k)], least[1 << k :]
        least = np.where(value[right] <= value[left], right, left)
    return starts, live[chosen]


def extended(hashes: np.ndarray, words: np.ndarray, at: np.ndarray, gram: int, window: int, first: np.ndarray, stops: np.ndarray):
    """Fingerprints extended to each side by half of what they lack of a window: ``(fingerprint, to the right, start, end, hash)``.

    A window around a fingerprint has that much on one side at least, so it holds one of both.
    """
    sums = np.concatenate(([0], np.cumsum(words)))
    ends = grams(hashes, words, gram, stops)[1][at]
    need = np.maximum(0, (window - (sums[ends] - sums[at]) + 1) // 2)
    left = np.where(need > 0, np.searchsorted(sums, sums[at] - need, "right") - 1, at)
    right = np.where(need > 0, np.searchsorted(sums, sums[ends] + need, "left"), ends)
    to_left, to_right = left >= first[at], (right <= stops[at]) & (need > 0)
    which = np.concatenate((np.flatnonzero(to_left), np.flatnonzero(to_right)))
    starts = np.concatenate((left[to_left], at[to_right]))
    ends = np.concatenate((ends[to_left], right[to_right]))
    return which, np.arange(len(which)) >= to_left.sum(), starts, ends, run_hashes(hashes, starts, ends)


def windows(hashes: np.ndarray, words: np.ndarray, window: int, first: np.ndarray | None = None, stops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the shortest runs with ``window`` words or more from each unit on and up to each unit.

    Together they cover every unit of every run of that length. ``first`` and ``stops`` have the bounds of each unit's text, where there
    are several.
    """
    sums = np.concatenate(([0], np.cumsum(words)))
    until = grams(hashes, words, window, stops)[1]
    starts = np.flatnonzero(until)
    low = np.zeros(len(hashes), np.int64) if first is None else first
    last = np.flatnonzero((words > 0) & (sums[1:] - sums[low] >= window))
    back = np.searchsorted(sums, sums[last + 1] - window, "right") - 1
    both = np.unique(np.concatenate((starts * (len(hashes) + 1) + until[starts], back * (len(hashes) + 1) + last + 1)))
    starts, ends = both // (len(hashes) + 1), both % (len(hashes) + 1)
    return starts, ends, run_hashes(hashes, starts, ends)


def first_lines(found: np.ndarray, starts: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """For each window, in order of their starts: whether an equal one starts in an earlier line of the document."""
    _, first, which = np.unique(found, return_index=True, return_inverse=True)
    return lines[starts] != lines[starts[first]][which]


def joined(many: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and words of the units of several texts in one piece, the bounds of each unit's text, and where texts begin."""
    sizes = np.array([len(u[0]) for u in many], np.int64)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    hashes, words = (np.concatenate([u[k] for u in many]) for k in (0, 1))
    return hashes, words.astype(np.int64), np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes), edges


def marks_of(hashes, words, first, stops, gram: int, window: int):
    """Starts and hashes of the fingerprints of all texts, extended to either side, in order of their starts."""
    at = fingerprints(hashes, words, gram, window, stops)
    _, _, starts, _, found = extended(hashes, words, at, gram, window, first, stops)
    order = np.argsort(starts, kind="stable")
    return starts[order], found[order].view(np.int64)


def standing_twice(marks: DataFrame, total: int) -> DataFrame:
    """The rows of ``marks`` whose ``mark`` stands in two rows or more.

    Marks are counted with map-side combine. Those that stand very often are few, ``HEAVY`` at most by what there are of rows, and
    reach the rows as a broadcast, so no mark that a third of all rows have goes to one task; the rest meet by a join. All of these
    joins keep or drop a row, none makes more of it.
    """
    counts = saved(marks.groupBy("mark").agg(F.count("*").alias("held")).where("held > 1"))
    often = F.lit(max(LEAST_HEAVY, total // HEAVY))
    heavy = counts.where(F.col("held") > often).select("mark")
    light = marks.join(F.broadcast(heavy), "mark", "left_anti").join(counts.where(F.col("held") <= often).select("mark"), "mark", "left_semi")
    return marks.join(F.broadcast(heavy), "mark", "left_semi").unionByName(light)


def repeated_runs(docs: DataFrame, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, key, gone, again, whole``: for each text that loses something, hashes of its windows that also stand in an
    earlier document, and of those that stand in an earlier line of the same one, which keeps the first; or ``whole``, if
    an earlier document has the same text, so that all windows go.

    ``key`` is a hash of the text. Earlier is by doc_id, then by line; ``r`` is a text's number in that order. Positions of
    fingerprints, extended to either side, are joined by what they hold; those that stand twice tell which windows may. Each
    such window of the first copy of a text meets its first place, so a run is followed as far as any earlier place has it.
    """

    def read(batches):
        for batch in batches:
            many = list(units(batch["text"].tolist()))
            rows = []
            if sum(len(u[0]) for u in many):
                hashes, words, first, stops, edges = joined(many)
                starts, marks = marks_of(hashes, words, first, stops, gram, window)
                bounds = np.searchsorted(starts, edges)
                ids, keys, n = batch["doc_id"].tolist(), batch["key"].tolist(), batch["n"].tolist()
                for text in np.flatnonzero(np.diff(bounds)).tolist():
                    own, size, lines = many[text]
                    turns = np.diff(lines, prepend=-1).astype(bool)
                    rows.append((n[text], ids[text], keys[text], own.tobytes(), (size + 128 * turns).astype(np.uint8).tobytes(), marks[bounds[text] : bounds[text + 1]]))
            yield pd.DataFrame(rows, columns=["n", "doc_id", "key", "hashes", "words", "marks"])

    def compare(batches):
        for batch in batches:
            if not len(batch):
                continue
            many = [(np.frombuffer(h, np.uint64), np.frombuffer(w, np.uint8)) for h, w in zip(batch["hashes"], batch["words"])]
            hashes, words, first, stops, edges = joined(many)
            lines, words = np.cumsum(words >> 7), words & 127  # a line has a number of its own among those of all texts
            heads, least = minima(hashes, words, gram, window, stops)
            at = np.unique(least)
            which, right, starts, ends, _ = extended(hashes, words, at, gram, window, first, stops)
            order = np.argsort(starts, kind="stable")
            alive = np.zeros(len(order), bool)
            alive[order[np.concatenate([np.asarray(a, np.int64) + b for a, b in zip(batch["at"], np.searchsorted(starts[order], edges[:-1]).tolist())])]] = True
            # how far each fingerprint is extended (out of reach: not at all), and whether that stands twice
            low, high = np.full(len(at), -1), np.full(len(at), len(hashes) + 1)
            left_twice, right_twice = np.zeros(len(at), bool), np.zeros(len(at), bool)
            low[which[~right]], left_twice[which[~right]] = starts[~right], alive[~right]
            high[which[right]], right_twice[which[right]] = ends[right], alive[right]
            # A window that stands twice has the same fingerprint there, and what it holds of the extended one stands twice.
            begin, end, run = windows(hashes, words, window, first, stops)
            own = np.searchsorted(at, least[np.searchsorted(heads, begin)])
            has_left, has_right = low[own] >= begin, high[own] <= end
            near = (has_left | has_right) & (~has_left | left_twice[own]) & (~has_right | right_twice[own])
            begin, run = begin[near], run[near].view(np.int64)
            own = np.searchsorted(edges, begin, "right") - 1
            order = np.lexsort((begin, run, own))
            begin, run, own = begin[order], run[order], own[order]
            fresh = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (run[1:] != run[:-1])))[: len(run)])
            which = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(run))))
            again = np.bincount(which[lines[begin] != lines[begin[fresh]][which]], minlength=len(fresh)) > 0
            yield pd.DataFrame({"r": batch["r"].to_numpy()[own[fresh]], "run": run[fresh], "again": again})

    ready(docs.sparkSession)
    # ids travel as text, since a null among numbers would turn all of a batch into doubles
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    texts = texts.withColumn("n", F.monotonically_increasing_id())
    lines = saved(texts.mapInPandas(read, "n long, doc_id string, key long, hashes binary, words binary, marks array<long>"))
    total = lines.agg(F.sum(F.size("marks"))).first()[0] or 0
    marks = lines.select("n", F.posexplode("marks").alias("i", "mark"))
    # Rows with the same id and the same text count as one. Null ids come last, so that they never are first while there is another.
    places = lines.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "key").agg(F.min("n").alias("n"))
    places = saved(places.orderBy(F.col("doc_id").asc_nulls_last(), "key").withColumn("r", F.monotonically_increasing_id()))
    firsts = places.groupBy("key").agg(F.min("r").alias("r"), F.min_by("n", "r").alias("n")).select("r", "n")
    at = standing_twice(marks, total).groupBy("n").agg(F.collect_list("i").alias("at"))
    near = lines.select("n", "hashes", "words").join(at.join(firsts, "n"), "n")
    held = saved(near.mapInPandas(compare, "r long, run long, again boolean"))
    first = held.groupBy("run").agg(F.min("r").alias("first"), F.count("*").alias("held"), F.max("again").alias("any")).where("held > 1 OR any")
    met = held.join(first.select("run", "first"), "run").withColumn("mine", F.col("r") == F.col("first")).where("NOT mine OR again")
    runs = lambda mine: F.collect_list(F.when(mine, F.col("run")))
    some = met.groupBy("r").agg(runs(~F.col("mine")).alias("gone"), runs(F.col("mine")).alias("again"))
    some = places.join(some, "r").select("doc_id", "key", "gone", "again", F.lit(False).alias("whole"))
    none = F.array().cast("array<long>")
    copies = places.join(firsts, "r", "left_anti").select("doc_id", "key", none.alias("gone"), none.alias("again"), F.lit(True).alias("whole"))
    return some.unionByName(copies)


def sketched(rows: DataFrame, held: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``may``: false only for rows whose ``names`` stand in no row of ``held``.

    One bit tells for all rows with the same hash. The bits are added up in bitmaps of 4096 bytes, ``SKETCH_BITS`` in all, so
    what is broadcast has a size of its own; beyond some hundred million rows of ``held`` it tells little, and most rows are true.
    """

    def bit(df):
        return df.withColumn("bit", F.pmod(F.xxhash64(*names), F.lit(SKETCH_BITS)) + 1).withColumns({"part": F.bitmap_bucket_number("bit"), "bit": F.bitmap_bit_position("bit")})

    bits = bit(held.select(*names)).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    may = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return bit(rows).join(F.broadcast(bits), "part", "left").withColumn("may", may).drop("part", "bit", "bits")


def dedup_lines(docs: DataFrame, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """All columns of ``docs (doc_id, text, ...)`` with the later copies of repeated runs of lines, and of passages inside
    long lines, cut out of ``text``, and ``lines_removed``: how many lines were cut, as a whole or in part.

    A unit is a short line or a piece of a long one (see ``units``). Every run of units with ``window`` words or more that
    also stands earlier in the corpus, at whatever place, goes; shorter repeats stay. So a passage of ``window +
    2 * CUT_WORDS - 1`` words goes wherever it stands within its line, but for some words at its ends. Of every unit the
    first copy by doc_id and line stays. What repeats within one line only, stays.

    A text that loses nothing stays as it is, byte by byte; null stays null and empty stays empty. Lines are parted by LF.
    Rows with the same id and the same text count as one and get the same result. Null ids come after all others. An
    existing column ``lines_removed`` is replaced. No rows: no rows.
    """

    @F.pandas_udf("text string, n int")
    def cut(texts: pd.Series, gone: pd.Series, again: pd.Series, whole: pd.Series) -> pd.DataFrame:
        rows = [(x, 0) for x in texts]
        for i in np.flatnonzero(whole.eq(True)).tolist():
            rows[i] = without_words(texts[i])
        some = [i for i in range(len(rows)) if gone[i] is not None and not whole[i]]
        for i, (hashes, words, lines) in zip(some, units([texts[i] for i in some])):
            starts, ends, found = windows(hashes, words, window)
            found = found.view(np.int64)
            out = np.isin(found, gone[i]) | np.isin(found, again[i]) & first_lines(found, starts, lines)
            edges = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(edges, starts[out], 1)
            np.add.at(edges, ends[out], -1)
            rows[i] = without(texts[i], np.cumsum(edges[:-1]) > 0, words, lines)
        return pd.DataFrame(rows, columns=["text", "n"])

    runs = saved(repeated_runs(docs.select("doc_id", "text"), gram, window))
    # the caller's columns go along in one struct, so none of them can clash with one of ours
    rows = docs.drop("lines_removed").select(F.struct("*").alias("row"))
    rows = rows.withColumns({"own_id": F.col("row.doc_id").cast("long"), "own_key": F.xxhash64(F.coalesce("row.text", F.lit("")))})
    runs = runs.withColumnsRenamed({"doc_id": "run_id", "key": "run_key"})
    rows = sketched(rows, runs.select(F.col("run_id").alias("own_id"), F.col("run_key").alias("own_key")), ["own_id", "own_key"])
    names = [c for c in docs.columns if c != "lines_removed"]

    def shown(df, text, n):
        return df.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in names], n.alias("lines_removed"))

    # only texts that may lose something are shuffled, and only those that do go to Python
    both = rows.where("may").join(runs, F.col("own_id").eqNullSafe(F.col("run_id")) & (F.col("own_key") == F.col("run_key")), "left")
    changed = F.col("gone").isNotNull()
    out = both.withColumn("cut", cut(F.when(changed, F.col("row.text")), "gone", "again", "whole"))
    out = shown(out, F.when(changed, F.col("cut.text")).otherwise(F.col("row.text")), F.when(changed, F.col("cut.n")).otherwise(0))
    return shown(rows.where("NOT may"), F.col("row.text"), F.lit(0)).unionByName(out)


def without(text: str, gone: np.ndarray, words: np.ndarray, lines: np.ndarray) -> tuple[str, int]:
    """The text without the units that go, and the number of lines that lose something."""
    kept, n = [], 0
    bounds = np.searchsorted(lines, np.arange(lines[-1] + 2))
    for line, a, b in zip(text.split("\n"), bounds[:-1].tolist(), bounds[1:].tolist()):
        out = gone[a:b]
        if not out.any():
            kept.append(line)
            continue
        n += 1
        if not out.all():
            stays = ~np.repeat(out, words[a:b])
            tokens = TOKENS.findall(line)
            left = "".join(t for t, s in zip(tokens, stays.tolist()) if s)
            kept.append(line[: len(line) - len(line.lstrip())] + (left if stays[-1] else left.rstrip()))
    return "\n".join(kept), n


def without_words(text: str) -> tuple[str, int]:
    """The text without all of its units, as ``without`` leaves it: blank lines at its ends, and the number of lines that went."""
    lines = text.split("\n")
    worded = [k for k, line in enumerate(lines) if line.strip()]
    return "\n".join(lines[: worded[0]] + lines[worded[-1] + 1 :]), worded[-1] + 1 - worded[0]
