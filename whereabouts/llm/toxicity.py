"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, averaged, blocks, judged, learnable, ready, saved, sigmoid

BITS = 20
PREFIXES = (4, 5, 6)
FACTORS = 8
CUT = 0.3


def terms(texts: list[bytes], bits: int = BITS):
    """For each block: the owner and the bucket of each word, then of the first 4, 5 and 6 bytes of longer words."""
    for data, starts, owners in blocks(texts):
        letters = ((data >= 97) & (data <= 122)) | (data >= 128)
        words = Words(data, letters)
        own = owners[np.searchsorted(starts, words.starts, "right") - 1]
        found = [(own, words.hashes(words.starts, words.ends))]
        for n in PREFIXES:
            long = words.ends - words.starts > n
            begin = words.starts[long]
            found.append((own[long], words.hashes(begin, begin + n) * np.uint64(2 * n + 1)))
        yield np.concatenate([o for o, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - bits)).astype(np.int64)


def fold(text: str | None) -> bytes:
    return (text or "").lower().encode()


def present(texts: list[bytes], place: np.ndarray | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct terms: owners and buckets, or places in the model for the buckets that have one."""
    size = (1 << bits) if place is None else len(place) + 1
    keys = []
    for own, bucket in terms(texts, bits):
        if place is not None:
            bucket = place[bucket]
            own, bucket = own[bucket >= 0], bucket[bucket >= 0]
        keys.append(np.unique(own * size + bucket))
    both = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return both // size, both % size


def chosen_terms(sample: DataFrame, least_z: float, most: int, bits: int) -> np.ndarray:
    """Buckets in five documents or more whose share of toxic ones differs from the rest's by ``least_z`` standard errors;
    the ``most`` clearest.

    Document frequencies are counted by Spark over the sample; they come back one row a chosen bucket.
    """

    def count(batches):
        for batch in batches:
            labels = batch["label"].to_numpy()
            own, bucket = present([fold(t) for t in batch["text"]], None, bits)
            seen, at = np.unique(bucket, return_inverse=True)
            yield pd.DataFrame({"bucket": seen, "n": np.bincount(at), "toxic": np.bincount(at, weights=labels[own]).astype(np.int64)})

    rows, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    share = toxic / rows
    df = sample.mapInPandas(count, "bucket int, n long, toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    df = df.where("n >= 5").withColumn("z", (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1))
    top = df.where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "bucket").limit(most).select("bucket").toPandas()
    return np.sort(top["bucket"].to_numpy(np.int64))


def paired_terms(sample: DataFrame, least_z: float, most: int, bits: int) -> np.ndarray:
    """Buckets of terms that tell something only beside another one: of the ``most`` terms in the most documents, those of a pair
    whose share of toxic documents differs from either term's own share by ``least_z`` standard errors, both to one side.

    Each task counts its documents' pairs in one matrix of ``most`` times ``most``, a parameter and not the data's size;
    Spark adds up what the matrices hold.
    """

    def count(batches):
        held = []
        for batch in batches:
            own, bucket = present([fold(t) for t in batch["text"]], place.value, bits)
            held.append((own + sum(h[2] for h in held), bucket, len(batch), batch["label"].to_numpy(np.float32)))
        if not held:
            return
        n = sum(h[2] for h in held)
        label = np.concatenate([h[3] for h in held])
        both, toxic = np.zeros((most, most), np.float32), np.zeros((most, most), np.float32)
        own, term = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        order = np.argsort(own, kind="stable")
        own, term = own[order], term[order]
        for top in range(0, n, 1024):
            a, b = np.searchsorted(own, (top, top + 1024))
            x = np.zeros((min(1024, n - top), most), np.float32)
            x[own[a:b] - top, term[a:b]] = 1
            both += x.T @ x
            toxic += (x * label[top : top + 1024, None]).T @ x
        i, j = np.nonzero(np.triu(both))
        yield pd.DataFrame({"i": i, "j": j, "n": both[i, j].astype(np.int64), "toxic": toxic[i, j].astype(np.int64)})

    rows = sample.count()
    df = sample.select("text").mapInPandas(lambda batches: _frequencies(batches, bits), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    top = df.where((F.col("n") >= 5) & (F.col("n") <= 0.9 * rows)).orderBy(F.desc("n"), "bucket").limit(most).select("bucket").toPandas()
    buckets = np.sort(top["bucket"].to_numpy(np.int64))
    of = np.full(1 << bits, -1, np.int32)
    of[buckets] = np.arange(len(buckets))
    place = sample.sparkSession.sparkContext.broadcast(of)
    pairs = sample.mapInPandas(count, "i int, j int, n long, toxic long").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    pairs = saved(pairs.where("n >= 5"))
    single = pairs.where("i = j").select("i", (F.col("toxic") / F.col("n")).alias("share"))
    met = pairs.where("i <> j").join(single.withColumnsRenamed({"share": "si"}), "i").join(single.select(F.col("i").alias("j"), F.col("share").alias("sj")), "j")
    off = lambda s: (F.col("toxic") - F.col("n") * F.col(s)) / F.sqrt(F.col("n") * F.col(s) * (1 - F.col(s)) + 1)
    met = met.withColumns({"zi": off("si"), "zj": off("sj")}).where((F.least("zi", "zj") >= least_z) | (F.greatest("zi", "zj") <= -least_z))
    found = met.select(F.explode(F.array("i", "j")).alias("i")).distinct().toPandas()  # ``most`` rows at most
    return buckets[np.sort(found["i"].to_numpy(np.int64))]


def _frequencies(batches, bits: int):
    for batch in batches:
        _, bucket = present([fold(t) for t in batch["text"]], None, bits)
        seen, n = np.unique(bucket, return_counts=True)
        yield pd.DataFrame({"bucket": seen, "n": n})


def margins(params: dict[str, np.ndarray], own: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bias, weights and half of (square of the sum - sum of squares) of the factors of the terms present."""
    v = params["v"][term]
    sums = np.zeros((n, v.shape[1]))
    squares, linear = np.zeros(n), np.zeros(n)
    if len(own):
        cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sums[own[cuts]] = np.add.reduceat(v, cuts, axis=0)
        squares[own[cuts]] = np.add.reduceat((v * v).sum(axis=1), cuts)
        linear[own[cuts]] = np.add.reduceat(params["w"][term], cuts)
    return params["b"][0] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def fit(params: dict[str, np.ndarray], data: bytes, steps: int = 60, rate: float = 0.05, decay: float = 3e-3) -> dict[str, np.ndarray]:
    """Adam on the log loss of one shard."""
    own, term, y = pickle.loads(data)
    now = {k: v.astype(np.float64) for k, v in params.items()}
    first, second = {k: np.zeros_like(v) for k, v in now.items()}, {k: np.zeros_like(v) for k, v in now.items()}
    for step in range(1, steps + 1):
        m, sums = margins(now, own, term, len(y))
        error = (sigmoid(m) - y) / len(y)
        at = error[own]
        grad = {"b": np.array([error.sum()]), "w": np.bincount(term, weights=at, minlength=len(now["w"])) + decay * now["w"]}
        push = at[:, None] * (sums[own] - now["v"][term])
        grad["v"] = np.stack([np.bincount(term, weights=push[:, k], minlength=len(now["w"])) for k in range(push.shape[1])], axis=1) + decay * now["v"]
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            now[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in now.items()}


def learn(docs: DataFrame, labels: DataFrame, most: int = 24000, terms_kept: int = 8192, least_z: float = 3.0, paired: int = 1024, least_pair_z: float = 6.0, shards: int = 8, shard_rows: int = 3000, rounds: int = 4, bits: int = BITS) -> dict[str, np.ndarray] | None:
    """Parameters of the machine: ``place`` of each bucket (-1: none), ``b``, ``w``, ``v``; None if nothing can be learned.

    Learns from at most ``most`` labelled rows that are not held out, in shards whose parameters are averaged after each
    of ``rounds`` rounds: one shard per ``shard_rows`` rows, at most ``shards``. In smaller ones most terms are missing,
    and averaging would hold their weights down. A term takes part if it tells something on its own (``chosen_terms``) or beside
    another one (``paired_terms``).
    """
    sample = saved(learnable(docs, labels, "toxic", most))
    rows = sample.count()
    if not rows:
        return None
    shards = min(shards, -(-rows // shard_rows))
    chosen = np.union1d(chosen_terms(sample, least_z, terms_kept, bits), paired_terms(sample, least_pair_z, paired, bits))
    place = np.full(1 << bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        own, term = present([fold(t) for t in group["text"]], sent.value, bits)
        data = pickle.dumps((own, term, group["label"].to_numpy(np.float64)))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "data": [data]})

    packed = saved(sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(pack, "shard int, data binary"))
    random = np.random.default_rng(7)
    start = {"b": np.array([-2.0], np.float32), "w": np.zeros(len(chosen), np.float32), "v": random.normal(0, 0.01, (len(chosen), FACTORS)).astype(np.float32)}
    return averaged(packed, fit, start, rounds) | {"place": place}


def toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, bits: int = BITS, keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """``keep`` columns, then ``held_out, score, predicted`` for every row of ``docs (doc_id, text)``.

    ``labels`` has ``doc_id, toxic``. Terms are lower-cased words and the first 4, 5 and 6 bytes of longer ones; a term
    counts once a document. Null texts count as empty; an empty text has the score of the bias alone. With no label to
    learn from all scores are 0. Equal texts have equal scores. Texts over 1 MB are scored whole, in pieces cut at
    blanks. No rows: no rows. The model's size is fixed by ``bits`` and ``terms_kept``.
    """
    spark = docs.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(learn(docs, labels, bits=bits, **how))

    def run(texts):
        params = model.value
        if params is None:
            return pd.Series(np.zeros(len(texts)))
        own, term = present([fold(t) for t in texts], params["place"], bits)
        return pd.Series(sigmoid(margins(params, own, term, len(texts))[0]))

    return judged(docs, run, cut, keep)
