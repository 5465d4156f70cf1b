"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, learnable, mixed, on_texts, powers, ready

ORDERS = (1, 2, 3, 4)
BITS = 16
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def grams(data: np.ndarray, starts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams that begin at each place, n by n, and a mask of those that stay within their text."""
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    ends = np.append(starts[1:], len(data)) - 1  # before the newline that parts the texts
    left = np.repeat(ends, np.diff(np.append(starts, len(data)))) - np.arange(len(data))
    found, inside = [], []
    for n in ORDERS:
        h = np.zeros(len(data), np.uint64)
        if len(data) >= n:
            h[: len(data) - n + 1] = (sums[n:] - sums[:-n]) * down[: len(data) - n + 1]
        found.append((mixed(h + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32))
        inside.append(left >= n)
    return np.stack(found), np.stack(inside)


def fold(text: str | None) -> bytes:
    return (text or "").lower().encode()


def learn(docs: DataFrame, most: int = 8000, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a matrix of log-probabilities with one row a language; its last column is the prior.

    Counts are summed within each task, then by Spark per language and bucket. ``docs`` has ``doc_id, text, lang``;
    at most ``most`` rows are learned from, chosen by a hash of the id.
    """
    known = docs.select("doc_id", "lang").where("lang IS NOT NULL")
    codes = sorted(r[0] for r in known.where(~held_out(F.col("doc_id"))).select("lang").distinct().collect())
    if not codes:
        return [], np.zeros((0, (1 << bits) + 1), np.float32)
    place = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("lang")).cast("int")
    known = known.select("doc_id", F.nullif(place, F.lit(0)).alias("lang"))

    def count(batches):
        sums = np.zeros((len(codes), 1 << bits), np.int64)
        rows = np.zeros(len(codes), np.int64)
        for batch in batches:
            labels = batch["label"].to_numpy() - 1
            np.add.at(rows, labels, 1)
            for data, starts, owners in blocks([fold(t) for t in batch["text"]]):
                found, inside = grams(data, starts, bits)
                lang = np.repeat(labels[owners], np.diff(np.append(starts, len(data))))
                for k in range(len(ORDERS)):
                    keep = inside[k]
                    sums += np.bincount(lang[keep] * (1 << bits) + found[k][keep], minlength=sums.size).reshape(sums.shape)
        lang, bucket = np.nonzero(sums)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": sums[lang, bucket]})
        yield pd.DataFrame({"lang": np.arange(len(codes)), "bucket": 1 << bits, "n": rows})

    sample = learnable(docs, known, "lang", most)
    total = sample.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(codes), (1 << bits) + 1))
    got = total.toPandas()  # languages x buckets at most
    table[got["lang"], got["bucket"]] = got["n"]
    counts, rows = table[:, :-1] + 0.1, table[:, -1:] + 1.0
    logs = np.hstack((np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(rows / rows.sum())))
    return codes, logs.astype(np.float32)


def score(texts: list[str | None], codes: list[str], logs: np.ndarray, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    sums = np.tile(logs[:, -1].astype(np.float64), (len(texts), 1))
    columns = np.ascontiguousarray(logs[:, :-1].T)
    for data, starts, owners in blocks([fold(t) for t in texts]):
        found, inside = grams(data, starts, bits)
        part = np.zeros((len(data), len(codes)), np.float32)
        for k in range(len(ORDERS)):
            part += columns[found[k]] * inside[k][:, None]
        np.add.at(sums, owners, np.add.reduceat(part, starts, axis=0, dtype=np.float64))
    best = sums.argmax(axis=1) if len(codes) else np.zeros(len(texts), int)
    chance = np.exp(sums - sums.max(axis=1, keepdims=True)) if len(codes) else np.zeros((len(texts), 1))
    sure = chance.max(axis=1) / np.maximum(chance.sum(axis=1), 1e-300)
    blank = np.array([not codes or not LETTER.search(t or "") for t in texts], dtype=bool)
    return [UNKNOWN if x else codes[b] for x, b in zip(blank, best)], np.where(blank, 0.0, sure)


def identify(docs: DataFrame, most: int = 8000, bits: int = BITS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs (doc_id, text, lang)``.

    Learns from rows that are not held out and whose ``lang`` is not null; only the text is an input of a prediction.
    Null texts and texts without a letter give ``und`` and 0, as does everything if nothing can be learned. Ties go to
    the language first in order of its name. Texts over 1 MB are scored whole, in pieces; n-grams across two pieces are
    not counted. No rows: no rows. The broadcast matrix has languages x 2**bits entries, whatever the data.
    """
    spark = docs.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(learn(docs, most, bits))

    def run(texts):
        codes, logs = model.value
        names, sure = score(texts, codes, logs, bits)
        return pd.DataFrame({"lang_pred": names, "score": sure})

    made = on_texts(F.col("text"), run, "struct<lang_pred:string,score:double>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), made.alias("made"))
    return rows.select("doc_id", "held_out", "made.lang_pred", "made.score")
