"""SimHash near-duplicates, compared exactly in tiles of fingerprints."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_texts, ready, saved
from .components import components

SHINGLE = 4
RADIUS = 4
QUARTERS = (0, 16, 32, 48)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of the whole text; no words: 0."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, cut at the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, len(words))
    last = len(words) - k + 1
    hashes = [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[:last].tolist(), (ends[k - 1 :] - 1).tolist())]
    return majority(np.array(hashes, dtype="<u8"))


_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 17):
        lanes = hashes[at : at + (1 << 17)].view(np.uint8).reshape(-1, 8) + _LANES
        ones += np.einsum("lv,vb->lb", np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256), _BITS).ravel()
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: Column) -> DataFrame:
    """``doc_id``, more columns, and ``fp``, the fingerprint as a signed long."""

    def run(texts):
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, on_texts(F.col("text"), run, "bigint").alias("fp"))


def _counts(fps: np.ndarray) -> np.ndarray:
    """Population counts: of all bits, then of each 16-bit quarter."""
    quarters = [np.bitwise_count((fps >> np.uint64(q)) & np.uint64(0xFFFF)) for q in QUARTERS]
    return np.stack([np.bitwise_count(fps), *quarters], axis=1).astype(np.int16)


def tiles(distinct: DataFrame, number: int) -> DataFrame:
    """``tile, lo, hi, fps``: runs of fingerprints ordered by population counts, with the bounds of their counts."""
    from pyspark import TaskContext

    def run(batches):
        got = [b["fp"].to_numpy(np.int64) for b in batches]
        fps = np.concatenate(got).view(np.uint64) if got else np.zeros(0, np.uint64)
        if len(fps):
            counts = _counts(fps)
            order = np.lexsort((fps, *counts.T[::-1]))
            yield pd.DataFrame(
                {"tile": [TaskContext.get().partitionId()], "lo": [counts.min(axis=0).tolist()], "hi": [counts.max(axis=0).tolist()], "fps": [fps[order].tobytes()]}
            )

    part = lambda q: F.bit_count(F.shiftrightunsigned("fp", q).bitwiseAND(F.lit(0xFFFF).cast("long")))
    keys = [F.bit_count("fp"), *[part(q) for q in QUARTERS], F.col("fp")]
    return distinct.repartitionByRange(number, *keys).mapInPandas(run, "tile int, lo array<int>, hi array<int>, fps binary")


def forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links at most ``radius`` bits apart between two tiles sorted by population count, thinned to a spanning forest.

    Every pair whose counts allow it is compared; links inside one connected group beyond a tree are not returned.
    """
    counts_a, counts_b = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    nodes, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(len(nodes))
    at_a, at_b = where[: len(a)], where[len(a) :]
    out = []
    for top in range(0, len(a), 64):
        rows = a[top : top + 64]
        first = np.searchsorted(counts_b, counts_a[top] - radius, "left")
        last = np.searchsorted(counts_b, counts_a[top + len(rows) - 1] + radius, "right")
        first = max(first, top) if same else first
        if first >= last:
            continue
        near = np.bitwise_count(rows[:, None] ^ b[None, first:last]) <= radius
        for row in np.flatnonzero(near.any(axis=1)).tolist():
            node = at_a[top + row]
            others = at_b[first + np.flatnonzero(near[row])]
            others = others[label[others] != label[node]]
            for group, index in zip(*np.unique(label[others], return_index=True)):
                out.append((int(nodes[node]), int(nodes[others[index]])))
                label[label == group] = label[node]
    return out


def links(distinct: DataFrame, number: int, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between distinct fingerprints that keep every component whole.

    A pair of tiles meets only if no bound on its population counts keeps all its pairs farther apart than the radius.
    """
    cut = saved(tiles(distinct, number))
    number = (cut.agg(F.max("tile")).first()[0] or 0) + 1  # as many as there are, however they were dealt
    boxes = cut.select("tile", "lo", "hi")
    ahead = boxes.select(F.col("tile").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), F.explode(F.sequence("tile", F.lit(number - 1))).alias("j"))
    pairs = ahead.join(boxes.select(F.col("tile").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j")), "j")
    gap = lambda k: F.greatest(F.get("lo_j", F.lit(k)) - F.get("hi_i", F.lit(k)), F.get("lo_i", F.lit(k)) - F.get("hi_j", F.lit(k)), F.lit(0))
    pairs = pairs.where((gap(0) <= radius) & (gap(1) + gap(2) + gap(3) + gap(4) <= radius)).select("i", "j")
    sides = pairs.select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("tile"))
    sides = sides.join(cut.select("tile", "fps"), "tile").repartition(max(8, number), "i", "j").sortWithinPartitions("i", "j", "tile")

    def run(batches):
        held = None
        for batch in batches:
            for i, j, tile, data in zip(batch["i"], batch["j"], batch["tile"], batch["fps"]):
                fps = np.frombuffer(data, dtype=np.uint64)
                if i != j and tile == i:
                    held = fps
                    continue
                found = forest(fps if i == j else held, fps, i == j, radius)
                if found:
                    ends = np.array(found, dtype=np.uint64).view(np.int64)
                    yield pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return sides.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = 1024) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs (doc_id, text)``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest doc_id reachable. Tiles hold
    about ``max(tile, 16 * sqrt(fingerprints))`` distinct fingerprints, so the number of tiles grows with the square root.
    Equal fingerprints meet once, as one row, however many documents share them.

    Null and empty texts, and texts of blanks, have fingerprint zero and link like any other. Repeated rows come back as
    often. A null doc_id keeps its row and never becomes a component's name unless it has no other. No rows: no rows.
    """
    marks = saved(fingerprints(docs, shingle))
    reps, roots = grouped(marks, radius, tile)
    named = reps.join(roots, "fp")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped(marks: DataFrame, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """``fp, rep`` with the smallest id of each fingerprint, and ``fp, root``, the component of each."""
    reps = saved(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = reps.count()
    number = max(1, math.ceil(n / max(tile, 16 * math.sqrt(n + 1))))
    roots = components(links(reps.select("fp"), number, radius))
    return reps, reps.select("fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = 1024) -> DataFrame:
    """One row of each component of ``docs (doc_id, text, ...)``, with all its columns: that of the smallest id.

    Null ids come last. Of rows that share the id, the one of the least hash of its columns stays; of rows equal in all
    columns, one. Null and empty texts are one component. No rows: no rows.
    """
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    whole = F.xxhash64(*hashed)
    marks = saved(fingerprints(docs, shingle, whole.alias("own")))
    _, roots = grouped(marks, radius, tile)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "own")
    rows = marks.groupBy("fp", place.alias("place")).agg(F.count("*").alias("copies"))
    best = rows.join(roots, "fp").groupBy("root").agg(F.min(F.struct("place", "copies")).alias("b")).select(F.col("b.place").alias("place_"), F.col("b.copies").alias("copies_"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), whole.alias("own"))
    kept = docs.select(F.struct("*").alias("row_"), row.alias("place_")).join(best, "place_")
    single = kept.where("copies_ = 1").select("row_.*")
    return single.unionByName(kept.where("copies_ > 1").dropDuplicates(["place_"]).select("row_.*"))
