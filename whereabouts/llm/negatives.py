"""Hard negatives by angular triangle filtering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, saved

DIRECTIONS = 8  # reference directions
SAMPLE = 1024  # rows that the directions are picked from
TILE = 2048  # rows of one label that are bounded together
BLOCK = 128  # anchors of one label that are bounded together
LANE = 65_536  # rows that one task holds
FILE = 8192  # anchors that one task holds
MOST = 1 << 62
HUGE = 2.0**500
SLACK = 1e-9  # of an angle and of a product of norms: far above what rounding can do to either

ROW = "vec_id long, label long, tag long, d int, cell int, near double, norm double, angles binary, x binary"
PACK = "pack long, label long, d int, n int, ids binary, tags binary, norms binary, angles binary, x binary, slots binary"


def directions(rows: DataFrame, many: int = DIRECTIONS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors far from each other, picked from at most ``sample`` rows (those of the least hash of the id).

    Which ones they are changes how much is filtered, never a result.
    """
    some = [np.asarray(r["x"], float) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").collect()]
    found = np.zeros((len(some), max([len(x) for x in some], default=0)))
    for at, x in enumerate(some):
        found[at, : len(x)] = x / max(np.abs(x).max(initial=0), 1e-300)
    found = found[np.abs(found).max(axis=1, initial=0) > 0]
    found = found / np.linalg.norm(found, axis=1, keepdims=True)
    chosen: list[int] = []
    closest = np.full(len(found), np.inf)
    while len(chosen) < min(many, len(found)):
        chosen.append(int(closest.argmax()))
        closest = np.minimum(closest, 1 - found @ found[chosen[-1]])
    return found[chosen]


def quantized(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that are exact, or Python integers where a double would not hold the product."""
    if np.abs(x).max(initial=0) < 2.0**1000 / scale:
        return np.floor(scale * x)
    return np.array([[int(v) * scale if abs(v) >= 2**60 else math.floor(scale * v) for v in row] for row in x.tolist()], dtype=object)


def measures(x: np.ndarray, refs: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The norm of each quantized row, infinite for huge ones, which thereby have no bounds, and its angle with each direction,
    by the half-angle form, which is exact at both ends."""
    tops = np.abs(x).max(axis=1, initial=0)
    huge = (tops >= HUGE)[:, None]
    q = np.where(huge, x / np.maximum(tops, 1e-300)[:, None], np.floor(scale * np.where(huge, 0, x)))
    norms = np.sqrt((q * q).sum(axis=1))
    unit = np.zeros((len(q), max(q.shape[1], refs.shape[1])))
    unit[:, : q.shape[1]] = q / np.where(norms > 0, norms, 1)[:, None]
    angles = np.empty((len(q), len(refs)))
    for at, ref in enumerate(refs):
        r = np.zeros(unit.shape[1])
        r[: len(ref)] = ref
        angles[:, at] = 2 * np.arctan2(np.linalg.norm(unit - r, axis=1), np.linalg.norm(unit + r, axis=1))
    return np.where(huge[:, 0], np.inf, norms), angles


def cosine_gap(a_low, a_high, b_low, b_high) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest angle that two sets may have, from intervals of their angles with each direction (last axis)."""
    least = np.maximum(np.maximum(a_low - b_high, b_low - a_high), 0).max(axis=-1, initial=0)
    most = np.minimum(a_high + b_high, 2 * np.pi - (a_low + b_low)).min(axis=-1, initial=np.pi)
    return least, most


def score_bounds(least, most, small, large) -> tuple[np.ndarray, np.ndarray]:
    """Safe bounds of the score from an interval of the angle and one of the product of both norms."""
    top, low = np.cos(np.maximum(least - SLACK, 0)), np.cos(np.minimum(most + SLACK, np.pi))
    with np.errstate(over="ignore", invalid="ignore"):
        above = np.where(top > 0, large, small) * top + large * SLACK + 1
        below = np.where(low > 0, small, large) * low - large * SLACK - 1
    known = large < 1e300
    return np.where(known, np.clip(below, -MOST, MOST), -MOST), np.where(known, np.clip(above, -MOST, MOST), MOST)


def scored(a: np.ndarray, a_norm: float, x: np.ndarray, x_norm: float) -> np.ndarray:
    """Exact integer inner products, beyond 2**62 cut to it; where lengths differ, missing components count as zero."""
    common = min(a.shape[1], x.shape[1])
    a, x = a[:, :common], x[:, :common]
    if a_norm * x_norm < 2.0**52:
        return (a @ x.T).astype(np.int64)  # no partial sum leaves what a double holds exactly
    if a_norm * x_norm < 2.0**62:
        return a.astype(np.int64) @ x.astype(np.int64).T
    exact = [[sum(int(p) * int(q) for p, q in zip(left, right)) for right in x.tolist()] for left in a.tolist()]
    return np.array([[max(-MOST, min(MOST, v)) for v in row] for row in exact], dtype=np.int64).reshape(len(a), len(x))


def measured(rows: DataFrame, refs: np.ndarray, scale: int) -> DataFrame:
    """Each row with its norm and its angles to the directions; ``cell`` is the nearest direction, -1 for a huge row."""

    def run(batches):
        for batch in batches:
            out = []
            for size, same in batch.groupby(batch["x"].map(len), sort=False):
                x = np.stack([np.asarray(v, float) for v in same["x"]]) if size else np.zeros((len(same), 0))
                norms, angles = measures(x, refs, scale)
                cell = np.where(np.isinf(norms), -1, angles.argmin(axis=1) if len(refs) else 0)
                near = angles.min(axis=1, initial=np.pi)
                out += zip(same["vec_id"], same["label"], same["tag"], [size] * len(x), cell, near, norms, map(bytes, angles), map(bytes, x))
            yield pd.DataFrame(out, columns=["vec_id", "label", "tag", "d", "cell", "near", "norm", "angles", "x"])

    return rows.mapInPandas(run, ROW)


def packed(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """Rows of one label and length that lie near each other, ``size`` to a pack; an exact repeat of a row is left out.

    Ranges end with the id, so no cell and no group of equal vectors is too large for a partition.
    """
    order = ["label", "d", "cell", "near", "vec_id", "tag"]
    names = [*order, "norm", "angles", "x", "slots"]

    def run(batches):
        from pyspark import TaskContext

        number, held, last = TaskContext.get().partitionId() << 32, [], None

        def pack():
            label, d = held[0][:2]
            c = list(zip(*held))
            column = lambda at, kind: np.array(c[at], kind).tobytes()
            return (number, label, d, len(held), column(4, np.int64), column(5, np.int64), column(6, float), b"".join(c[7]), b"".join(c[8]), np.concatenate([np.frombuffer(s, np.int64) for s in c[9]]).tobytes())

        for batch in batches:
            out = []
            for row in batch[names].itertuples(index=False, name=None):
                if last == (row[4], row[5]):
                    continue
                last = (row[4], row[5])
                if held and (row[:2] != held[0][:2] or min(row[2], 0) != min(held[0][2], 0) or len(held) >= size or len(held) * row[1] >= 1 << 20):
                    out.append(pack())
                    number, held = number + 1, []
                held.append(row)
            yield pd.DataFrame(out, columns=PACK_NAMES)
        if held:
            yield pd.DataFrame([pack()], columns=PACK_NAMES)

    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.select(*names).mapInPandas(run, PACK)


PACK_NAMES = [c.split()[0] for c in PACK.split(", ")]
WHOLE_RANGE = (0, -MOST, MOST)


class Pack:
    """One pack as arrays; slots are rows of (slot, lowest score, highest score), as many to each anchor."""

    def __init__(self, row, scale: int):
        self.label, self.n = row.label, row.n
        self.ids, self.tags, self.norms = (np.frombuffer(b, t) for b, t in ((row.ids, np.int64), (row.tags, np.int64), (row.norms, float)))
        self.angles = np.frombuffer(row.angles, float).reshape(row.n, -1)
        self.q = quantized(np.frombuffer(row.x, float).reshape(row.n, row.d), scale)
        self.slots = np.frombuffer(row.slots, np.int64).reshape(row.n, -1, 3) if row.slots else None
        self.low, self.high = (f(axis=0) for f in (self.angles.min, self.angles.max)) if row.n else (None, None)


def best_of(block: Pack, tiles: list[Pack], k: int, same: bool):
    """For each anchor and slot the ``k`` best rows of the tiles within the slot's scores: ``(anchor, slot, ids, scores)``.

    The tile with the highest possible score comes first; a tile, and then a row, is left out where its bounds meet no
    window that is still open. A window closes from below as its k-th score rises.
    """
    tiles = [t for t in tiles if (t.label == block.label) == same]
    if not tiles:
        return
    small, large = (np.array([f(t.norms) for t in tiles]) for f in (np.min, np.max))
    least, most = cosine_gap(block.low, block.high, np.stack([t.low for t in tiles]), np.stack([t.high for t in tiles]))
    below, above = score_bounds(least, most, small * block.norms.min(), large * block.norms.max())
    floor, top = block.slots[:, :, 1].copy(), block.slots[:, :, 2]
    open_ = floor <= top
    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for at in np.argsort(-above, kind="stable").tolist():
        tile = tiles[at]
        lowest = np.where(open_, floor, MOST).min(axis=1)
        highest = np.where(open_, top, -MOST).max(axis=1)
        live = np.flatnonzero((above[at] >= lowest) & (below[at] <= highest) & open_.any(axis=1))
        if not len(live):
            continue
        least = np.zeros((len(live), tile.n))
        most = np.full((len(live), tile.n), np.pi)
        for j in range(block.angles.shape[1]):
            a, x = block.angles[live, j][:, None], tile.angles[:, j][None, :]
            np.maximum(least, np.abs(a - x), out=least)
            np.minimum(most, np.minimum(a + x, 2 * np.pi - (a + x)), out=most)
        product = block.norms[live][:, None] * tile.norms[None, :]
        low, high = score_bounds(least, most, product, product)
        meets = (high >= lowest[live][:, None]) & (low <= highest[live][:, None])
        if same:
            meets &= block.ids[live][:, None] != tile.ids[None, :]
        rows = np.flatnonzero(meets.any(axis=0))
        if not len(rows):
            continue
        meets = meets[:, rows]
        scores = scored(block.q[live], float(block.norms[live].max()), tile.q[rows], float(tile.norms[rows].max()))
        for i, anchor in enumerate(live.tolist()):
            ids, own = tile.ids[rows][meets[i]], scores[i][meets[i]]
            inside = (own[None, :] >= floor[anchor][:, None]) & (own[None, :] <= top[anchor][:, None]) & open_[anchor][:, None]
            for slot in np.flatnonzero(inside.any(axis=1)).tolist():
                new_ids, new = ids[inside[slot]], own[inside[slot]]
                if (anchor, slot) in found:
                    new_ids, new = (np.concatenate(p) for p in zip(found[anchor, slot], (new_ids, new)))
                best = np.lexsort((new_ids, -new))[:k]
                found[anchor, slot] = new_ids[best], new[best]
                if len(best) == k:
                    floor[anchor, slot] = new[best[-1]]
    for (anchor, slot), (ids, own) in found.items():
        yield anchor, int(block.slots[anchor, slot, 0]), ids, own


def searched(anchors: DataFrame, tiles: DataFrame, n_anchors: int, n_rows: int, k: int, same: bool, scale: int) -> DataFrame:
    """``anchor_id, anchor_tag, slot, rank, id, score``: tiles are dealt over lanes, blocks of anchors over files, and a
    task holds one lane and one file, so its memory is bounded at any size."""
    lanes = max(1, math.ceil(n_rows / LANE))
    files = max(1, math.ceil(n_anchors / FILE), min(16, math.ceil(n_anchors / 64)))
    blocks = packed(anchors, max(1, math.ceil(n_anchors / FILE)), BLOCK)
    left = blocks.withColumns({"file": F.pmod(F.xxhash64("pack"), F.lit(files)).cast("int"), "lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))})
    right = tiles.withColumns({"lane": F.pmod(F.xxhash64("pack"), F.lit(lanes)).cast("int"), "file": F.explode(F.sequence(F.lit(0), F.lit(files - 1)))})

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        held = [Pack(r, scale) for r in others.itertuples(index=False)] if len(own) else []
        out = []
        for row in own.itertuples(index=False):
            block = Pack(row, scale)
            for anchor, slot, ids, scores in best_of(block, held, k, same):
                out += [(int(block.ids[anchor]), int(block.tags[anchor]), slot, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        return pd.DataFrame(out, columns=["anchor_id", "anchor_tag", "slot", "id", "score"])

    found = left.groupBy("lane", "file").cogroup(right.groupBy("lane", "file")).applyInPandas(run, "anchor_id long, anchor_tag long, slot int, id long, score long")
    order = Window.partitionBy("anchor_id", "anchor_tag", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, of: int = 100, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``rows (vec_id, label, vector)``.

    Each component becomes floor(scale * x); a score is the integer inner product. Anchors are rows whose id is divisible
    by ``every``, their positives the best rows of the same label with another id, and the negatives of a positive the best
    rows of another label with ``low * positive <= of * negative <= high * positive``. Ties go to the smaller id.

    The angles of each row to some directions bound its angle to any other row by the triangle inequality on the sphere,
    and with both norms its score; only rows whose bounds meet an open window are scored. All rows are searched.

    Rows with a null id, label or vector or with a null or non-finite component take no part. Rows that agree in id, label
    and vector count once; rows that share an id alone each count. Empty and zero vectors score 0; of vectors of unlike
    lengths the missing components count as zero. Scores beyond 2**62 count as 2**62. Other columns are not read. No rows: no rows.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ready(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    rows = rows.select("vec_id", "label", F.xxhash64("label", "vector").alias("tag"), F.col("vector").alias("x"))
    whole = F.lit(np.array([WHOLE_RANGE], np.int64).tobytes())
    found = saved(measured(rows, directions(rows), scale))
    n = found.count()
    tiles = saved(packed(found.withColumn("slots", F.lit(b"")), max(1, math.ceil(n / LANE)), TILE))
    anchors = found.where(F.col("vec_id") % every == 0)
    n_anchors = anchors.count()
    near = saved(searched(anchors.withColumn("slots", whole), tiles, n_anchors, n, positives, True, scale))

    def windows(batches):
        for batch in batches:
            out = []
            for anchor, tag, found in zip(batch["anchor_id"], batch["anchor_tag"], batch["found"]):
                ranges = [(f["rank"], -(-low * int(f["score"]) // of), high * int(f["score"]) // of) for f in found]
                ranges += [(0, MOST, -MOST)] * (positives - len(ranges))
                out.append((anchor, tag, np.array(ranges, np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "tag", "slots"])

    of_each = near.groupBy("anchor_id", "anchor_tag").agg(F.collect_list(F.struct("rank", "score")).alias("found"))
    asked = anchors.join(of_each.mapInPandas(windows, "vec_id long, tag long, slots binary"), ["vec_id", "tag"])
    got = searched(asked, tiles, n_anchors, n, negatives, False, scale)
    first = near.select("anchor_id", "anchor_tag", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return got.join(first, ["anchor_id", "anchor_tag", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INT AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 10
"""
