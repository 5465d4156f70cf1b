"""Approximate nearest neighbours: probed lists scanned dimension block by dimension block, with early abandonment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, saved

STEP = 8  # dimensions added before each test
EPSILON = 2.1  # width of the test: a larger value abandons later
BLOCK_ROWS = 2048


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix: after it, any first dimensions of a difference are a fair sample of its length."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    random = np.random.default_rng(seed)
    found = sample[random.choice(len(sample), size=min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], found)
    return found


def unit(vectors: list) -> np.ndarray:
    rows = np.array([np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row in double precision, so that equal vectors have equal scores wherever they stand."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * math.sqrt((query * query).sum()))


def scan(query: np.ndarray, rows: np.ndarray, k: int, step: int = STEP, epsilon: float = EPSILON) -> np.ndarray:
    """Places of the rows that may be among the ``k`` nearest to a rotated unit query.

    The first rows give a bound. The rest add up squared differences, ``step`` dimensions at a time; a row goes when
    its partial distance, scaled to all dimensions, exceeds the bound by more than the test allows, and nearer rows that
    reach the end lower the bound for the next part of the list.
    """
    dims = len(query)
    kept: list[np.ndarray] = []
    bound, near = math.inf, np.zeros(0)
    edges = [0, *range(max(k, 32), len(rows), 512)]
    for at, until in zip(edges, [*edges[1:], len(rows)]):
        live = np.arange(at, until)
        far = np.zeros(len(live))
        for d in range(0, dims, step):
            part = rows[live, d : d + step] - query[d : d + step]
            far = far + np.einsum("ij,ij->i", part, part)
            done = min(d + step, dims)
            if done < dims and bound < math.inf:
                stay = far * (dims / done) <= bound * (1 + epsilon / math.sqrt(done)) ** 2
                live, far = live[stay], far[stay]
                if not len(live):
                    break
        stay = far <= bound + 1e-9
        kept.append(live[stay])
        near = np.sort(np.concatenate((near, far[stay])))[:k]
        bound = near[-1] if len(near) == k else math.inf
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def nearest(rows: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", column: str = "embedding", probes: float = 0.6, most_sampled: int = 20_000, lists: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its ``k`` nearest others.

    Nearness is the cosine in double precision on the vectors as given; ties go to the smaller id. Vectors that are null,
    zero (or of a squared length that a double can't hold), hold a
    null or non-finite component, or have another number of dimensions than most, take no part; nor do null ids. Equal vectors
    are searched once: of each, the ``k + 1`` smallest ids stand for all, as no others can be among the nearest. Rows that
    repeat an id and its vector count once.

    Every vector is placed in the list of its nearest centroid (k-means over at most ``most_sampled`` rows, chosen by a
    hash of the id); a query probes the nearest ``probes`` share of the ``lists``, at least eight. Lists are scanned in
    blocks of about 2048 vectors, so a large list is many tasks. Queries that find
    fewer than they need in their probed lists probe all. What is broadcast has ``lists`` x dimensions numbers, with eight to 1024 lists of about
    512 vectors or more. No rows: no rows.
    """
    spark = rows.sparkSession
    ready(spark)
    given = rows.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sound = given.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sound = sound.where((length > 0) & (length < float("inf")))
    dims = [r["dims"] for r in sound.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()]
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sound = sound.where(F.size("v") == dims[0])
    first = sound.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    members = first.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_set("id")).alias("ids"))
    asked = sound.where(F.col("id") % every == 0).select("id", "v").distinct()
    members = saved(members)
    sampled = [r["v"] for r in members.orderBy(F.xxhash64("rep")).limit(most_sampled).select("v").collect()]
    number = lists or max(8, min(1024, members.count() // 512))
    centres = centroids(unit(sampled), number)
    probed = min(len(centres), max(8, math.ceil(probes * len(centres))))
    model = spark.sparkContext.broadcast((centres, rotation(dims[0])))

    def place(batches):
        centres, _ = model.value
        for batch in batches:
            near = (unit(list(batch["v"])) @ centres.T).argmax(axis=1) if len(batch) else []
            yield batch.assign(list=np.asarray(near, np.int32))

    def probe(batches):
        centres, _ = model.value
        for batch in batches:
            if len(batch):
                near = np.argsort(-(unit(list(batch["v"])) @ centres.T), axis=1, kind="stable")[:, :probed]
                yield pd.DataFrame({"rep": np.repeat(batch["rep"], probed), "v": [v for v in batch["v"] for _ in range(probed)], "list": near.ravel().astype(np.int32)})

    placed = saved(members.mapInPandas(place, "v array<double>, rep long, ids array<long>, list int"))
    blocks = placed.groupBy("list").agg(_parts("blocks"))
    wanted = saved(members.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("w")), F.col("v") == F.col("w")).select("query_id", "rep", "v"))
    queries = wanted.select("rep", "v").distinct()

    def search(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        turn = model.value[1]
        out = []
        if len(held):
            held = held.sort_values("rep", ignore_index=True)
            exact = np.array([np.asarray(v) for v in held["v"]])
            turned = (exact / np.sqrt((exact * exact).sum(axis=1))[:, None]) @ turn
            for rep, v in zip(asked["rep"], asked["v"]):
                v = np.asarray(v)
                found = scan((v / math.sqrt((v * v).sum())) @ turn, turned, k + 1)
                score = cosine(v, exact[found])
                best = np.lexsort((held["rep"].to_numpy()[found], -score))[: k + 1]
                out += [(rep, score[b], held["ids"][found[b]]) for b in best]
        return pd.DataFrame(out, columns=["rep", "score", "ids"])

    def searched(sent: DataFrame) -> DataFrame:
        """Meets blocks of queries with blocks of the lists they probe."""
        turns = sent.groupBy("list").agg(_parts("turns"))
        both = F.broadcast(blocks.join(turns, "list"))
        across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        left = sent.join(both, "list").select("list", "rep", "v", deal("turns").alias("turn"), across("blocks").alias("block"))
        right = placed.join(both, "list").select("list", "rep", "v", "ids", deal("blocks").alias("block"), across("turns").alias("turn"))
        groups = left.groupBy("list", "block", "turn").cogroup(right.groupBy("list", "block", "turn"))
        return groups.applyInPandas(search, "rep long, score double, ids array<long>")

    met = saved(searched(saved(queries.mapInPandas(probe, "rep long, v array<double>, list int"))))
    enough = met.groupBy("rep").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > k).select("rep")
    short = saved(queries.join(enough, "rep", "left_anti"))
    if not short.isEmpty():
        everywhere = short.select("rep", "v", F.explode(F.sequence(F.lit(0), F.lit(len(centres) - 1))).alias("list"))
        met = met.join(short.select("rep"), "rep", "left_anti").unionByName(searched(saved(everywhere)))
    return _ranked(met, wanted.select("query_id", "rep"), k)


def _parts(name: str):
    return F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias(name)


def _ranked(met: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The nearest ``k`` of what the blocks found, for every query row: first per vector, then per row without itself."""
    one = met.select("rep", "score", F.explode("ids").alias("vec_id"))
    order = [F.col("score").desc(), "vec_id"]
    best = one.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(*order))).where(F.col("n") <= k + 1)
    rows = wanted.select("query_id", "rep").join(best, "rep").where("vec_id <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
