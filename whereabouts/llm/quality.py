"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, averaged, blocks, judged, learnable, ready, saved, sigmoid

PASSAGE = 1024  # bytes
HIDDEN = 24
GATE = 12
CUT = 0.7
# Classes of bytes. Letters are 0 (small, or beyond ASCII) and 1 (large).
GROUPS = {1: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2: b"0123456789", 3: b" ", 4: b"\n\r\t", 5: b".", 6: b",", 7: b"!?", 8: b"|", 9: b"*&%#$@~^=+<>{}[]\\_", 10: b"'\"():;-/`"}
CLASSES = 12
CLASS = np.zeros(256, np.int64)
CLASS[:32] = 11
for _group, _bytes in GROUPS.items():
    CLASS[list(_bytes)] = _group
FEATURES = CLASSES * CLASSES + 5


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(owners, features)``: one row for each passage of each text, in order; an empty text has one row of zeros."""
    owners, rows = [], []
    for data, starts, own in blocks([(t or "").encode() for t in texts]):
        lengths = np.diff(np.append(starts, len(data)))
        counts = -(-lengths // PASSAGE)
        base = np.concatenate(([0], np.cumsum(counts)[:-1]))
        offset = np.arange(len(data)) - np.repeat(starts, lengths)
        passage = np.repeat(base, lengths) + offset // PASSAGE
        n = int(counts.sum())
        kind = CLASS[data]
        pair = kind[:-1] * CLASSES + kind[1:]
        size = np.bincount(passage, minlength=n)
        shares = np.bincount(passage[:-1] * CLASSES**2 + pair, minlength=n * CLASSES**2).reshape(n, -1) / size[:, None]
        words = Words(data, (kind != 3) & (kind != 4))
        more = np.zeros((n, 5))
        if len(words.starts):
            h, where = words.hashes(words.starts, words.ends), passage[words.starts]
            many = np.maximum(np.bincount(where, minlength=n), 1)
            again = lambda k: np.bincount(where[k:], weights=(h[k:] == h[:-k]) & (where[k:] == where[:-k]), minlength=n) / many
            more[:, 0], more[:, 1] = again(1), again(2)
            distinct = np.unique(np.stack((where.astype(np.uint64), h)), axis=1)[0].astype(np.int64)
            more[:, 2] = 1 - np.bincount(distinct, minlength=n) / many
            more[:, 3] = np.bincount(where, weights=words.ends - words.starts, minlength=n) / many / 20
        more[:, 4] = np.log1p(size) / 10
        whole = np.hstack((np.sqrt(shares), more)).astype(np.float32)
        whole[np.repeat(lengths == 1, counts)] = 0
        owners.append(np.repeat(own, counts))
        rows.append(whole)
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, FEATURES), np.float32)
    return np.concatenate(owners), np.concatenate(rows)


def forward(p: dict[str, np.ndarray], own: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Encodes the passages, weighs them by gated attention within their document, and scores the weighted sum."""
    cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    bag = np.cumsum(np.concatenate(([0], (own[1:] != own[:-1]).astype(np.int64))))
    x = (x - p["mean"]) / p["spread"]
    h = np.tanh(x @ p["w"] + p["wb"])
    t, g = np.tanh(h @ p["t"]), sigmoid(h @ p["g"])
    e = (t * g) @ p["a"]
    e = np.exp(e - np.maximum.reduceat(e, cuts)[bag])
    weight = e / np.add.reduceat(e, cuts)[bag]
    z = np.add.reduceat(h * weight[:, None], cuts, axis=0)
    return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "bag": bag, "cuts": cuts, "logit": z @ p["c"] + p["cb"][0]}


def gradient(p: dict[str, np.ndarray], own: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(p, own, x)
    error = (sigmoid(f["logit"]) - y) / len(y)
    bag, weight, h = f["bag"], f["weight"], f["h"]
    to_z = error[:, None] * p["c"][None, :]
    to_h = to_z[bag] * weight[:, None]
    pull = (to_z[bag] * h).sum(axis=1)
    to_e = weight * (pull - np.add.reduceat(weight * pull, f["cuts"])[bag])
    to_tg = to_e[:, None] * p["a"][None, :]
    to_t, to_g = to_tg * f["g"] * (1 - f["t"] ** 2), to_tg * f["t"] * f["g"] * (1 - f["g"])
    to_h = (to_h + to_t @ p["t"].T + to_g @ p["g"].T) * (1 - h**2)
    return {
        "w": f["x"].T @ to_h, "wb": to_h.sum(axis=0), "t": h.T @ to_t, "g": h.T @ to_g,
        "a": (f["t"] * f["g"]).T @ to_e, "c": f["z"].T @ error, "cb": np.array([error.sum()]),
    }


def fit(params: dict[str, np.ndarray], data: bytes, steps: int = 60, rate: float = 0.01, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Adam on the log loss of one shard."""
    own, x, y = pickle.loads(data)
    now = {k: v.astype(np.float32) for k, v in params.items()}
    first, second = {k: np.zeros_like(v) for k, v in now.items()}, {k: np.zeros_like(v) for k, v in now.items()}
    for step in range(1, steps + 1):
        for k, g in gradient(now, own, x, y).items():
            g = g + decay * now[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            now[k] = (now[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return now


def learn(docs: DataFrame, labels: DataFrame, most: int = 12000, shards: int = 8, rounds: int = 5) -> dict[str, np.ndarray] | None:
    """Parameters of the network, learned from at most ``most`` labelled rows that are not held out; None without any."""
    sample = learnable(docs, labels, "quality", most)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        own, x = passages(list(group["text"]))
        y = group["label"].to_numpy(np.float32)
        sums = np.stack((x.sum(axis=0), (x.astype(np.float64) ** 2).sum(axis=0), np.full(FEATURES, len(x))))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "data": [pickle.dumps((own, x, y))], "sums": [sums.tobytes()], "good": [float(y.mean())]})

    packed = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).groupBy("shard")
    packed = saved(packed.applyInPandas(pack, "shard int, data binary, sums binary, good double"))
    moments = packed.select("sums", "good").collect()
    if not moments:
        return None
    total, squares, n = np.sum([np.frombuffer(r["sums"]).reshape(3, -1) for r in moments], axis=0)
    mean = total / n
    random = np.random.default_rng(11)
    draw = lambda a, b: random.normal(0, a**-0.5, (a, b)).astype(np.float32)
    good = np.clip(np.mean([r["good"] for r in moments]), 0.01, 0.99)
    start = {
        "mean": mean.astype(np.float32), "spread": (np.sqrt(np.maximum(squares / n - mean**2, 0)) + 0.02).astype(np.float32),
        "w": draw(FEATURES, HIDDEN), "wb": np.zeros(HIDDEN, np.float32), "t": draw(HIDDEN, GATE), "g": draw(HIDDEN, GATE),
        "a": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "cb": np.array([np.log(good / (1 - good))], np.float32),
    }
    return averaged(packed.select("shard", "data"), fit, start, rounds)


def quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """``keep`` columns, then ``held_out, score, predicted`` for every row of ``docs (doc_id, text)``.

    ``labels`` has ``doc_id, quality``. A text is cut into passages of 1024 bytes, all of which are encoded; the score is
    that of their weighted sum. Null texts count as empty; an empty text is one passage of zeros. With no label to learn
    from all scores are 1. Equal texts have equal scores. Texts over 1 MB are cut into passages in pieces, and all their
    passages meet in one weighted sum. No rows: no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(learn(docs, labels, **how))

    def run(texts):
        params = model.value
        chance = np.ones(len(texts))
        if params is not None and len(texts):
            own, x = passages(texts)
            chance = sigmoid(forward(params, own, x)["logit"])
        return pd.Series(chance.astype(np.float64))

    return judged(docs, run, cut, keep)
