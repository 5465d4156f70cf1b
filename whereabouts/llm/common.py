"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHIPPED: set[str] = set()
BLOCK = 1 << 20  # bytes of text that numpy works on at a time


def ready(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, and keeps Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="whereabouts-code-"), "whereabouts_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("whereabouts", os.path.relpath(full, top)))
    context.addPyFile(path)
    SHIPPED.add(context.applicationId)


def saved(df: DataFrame) -> DataFrame:
    """Writes a table into the shared checkpoint folder and reads it again: lost executors cost no earlier step."""
    from whereabouts.session import checkpoint_dir

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_texts(text: Column, run: Callable[[list], "pd.Series | pd.DataFrame"], kind: str) -> Column:
    """A column that ``run`` makes of the texts of one Arrow batch at a time (a list; null is None).

    Only texts go to Python, so ids, which pandas would turn into doubles beside a null, and all other columns stay as they are.
    Not to be moved or repeated by the optimizer: it is the costly step.
    """
    if kind.startswith("struct"):

        @F.pandas_udf(kind)
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield run(texts.tolist())

    else:

        @F.pandas_udf(kind)
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield run(texts.tolist())

    return made.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def judged(docs: DataFrame, run: Callable[[list], pd.Series], cut: float, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, then ``held_out, score, predicted``; columns of the same name are left out of ``keep``."""
    made = on_texts(F.col("text"), run, "double")
    kept = [c for c in keep if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*kept, held_out(F.col("doc_id")).alias("held_out"), made.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def learnable(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """``doc_id, text, label`` (0/1) of at most ``most`` labelled rows, chosen by a hash of the id.

    A repeated label counts once, as its largest value; null labels and held-out ids are left out.
    The ids are few (``most``), so they go to the documents as a broadcast.
    """
    known = labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def cut_long(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """The text in pieces of at most ``size`` bytes, cut at a blank where there is one."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(b" ", at + 1, at + size)
        end = end if end > at else at + size
        yield text[at:end]
        at = end
    yield text[at:]


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(bytes, starts, owners)``: pieces joined by a newline byte, where each starts, and the text each belongs to."""
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0
    for owner, text in enumerate(texts):
        for piece in cut_long(text, size):
            if parts and held + len(piece) > size:
                yield _joined(parts, owners)
                parts, owners, held = [], [], 0
            parts.append(piece)
            owners.append(owner)
            held += len(piece) + 1
    if parts:
        yield _joined(parts, owners)


def _joined(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    return data, np.concatenate(([0], np.cumsum(lengths)[:-1])), np.array(owners, dtype=np.int64)


BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a block and a hash of any span of bytes in it, without a loop over words."""

    def __init__(self, data: np.ndarray, in_word: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        edge = np.diff(np.concatenate(([0], in_word.view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def averaged(shards: DataFrame, fit, start: dict[str, np.ndarray], rounds: int) -> dict[str, np.ndarray]:
    """Iterative parameter mixing: each shard goes on from the same parameters, and their mean starts the next round.

    ``shards`` has columns ``shard`` and ``data`` (binary), a bounded number of rows; ``fit(params, data)`` returns
    parameters. What reaches the driver is one set of parameters per shard.
    """
    import pickle

    spark = shards.sparkSession
    now = start
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(pickle.dumps(now))

        def run(batches, sent=sent):
            import pandas as pd

            for batch in batches:
                for shard, data in zip(batch["shard"], batch["data"]):
                    out = fit(pickle.loads(sent.value), data)
                    yield pd.DataFrame({"shard": [shard], "params": [pickle.dumps(out)]})

        got = sorted(shards.mapInPandas(run, "shard int, params binary").collect(), key=lambda r: r["shard"])
        got = [pickle.loads(r["params"]) for r in got]
        if not got:
            return now
        now = {k: np.mean([g[k] for g in got], axis=0).astype(np.float32) for k in start}
    return now
