"""Token ids of documents in ORC files: read in parallel by stripe, pruned by what their footers and indexes say."""

from __future__ import annotations

import math
import uuid
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready
from .packing import encoder

END = 2
PART_BYTES = 32 << 20  # text of a file
MOST_PARTS = 50_000  # files; beyond, each takes more text
CHUNK = 4096  # ids of a row
STRIPE = 8 << 20
STRIDE = 1000  # rows to an entry of the row index and of its Bloom filter
SCHEMA = "part int, place long, offset long, doc_id long, chunk int, chunks int, n int, ids array<int>"
POLYNOMIAL = 0xEDB88320  # fixed value: that of CRC-32, lowest power in the highest bit


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = END, part_bytes: int = PART_BYTES, chunk: int = CHUNK, stripe: int = STRIPE) -> None:
    """Writes the ids of ``docs (doc_id, text)`` and an end id for each as ORC files below ``path``, in order of doc_id.

    A document is one row, or several of ``chunk`` ids, so no row grows with a text. ``part`` is the file's number in the order of ids,
    ``place`` the document's in the file, ``offset`` the number of ids before it there. The ids are integers in run-length
    encoding; stripes hold about ``stripe`` bytes; a row index and a Bloom filter on doc_id stand for every thousand rows.

    Files are ranges of (doc_id, row of the input), so rows that share an id are parted too. Texts are shuffled
    once; ranges are sampled from the ids alone. Null text is empty; null ids come last; repeated rows are written each.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, math.ceil(size / part_bytes)))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        library, part, place, offset = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0

        def batch_of(rows, held):
            values = np.frombuffer(b"".join(held), dtype="<i4")
            columns = list(zip(*rows)) or [[]] * 7
            bounds = np.concatenate(([0], np.cumsum(np.array(columns[6], np.int64)))).astype(np.int32)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "place", "offset", "doc_id", "chunk", "chunks", "n", "ids"])

        rows, held, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = library.ids(text or "") + last
                n = len(ids) // 4
                chunks = -(-n // chunk)
                for k in range(chunks):
                    cut = ids[4 * k * chunk : 4 * (k + 1) * chunk]
                    rows.append((part, place, offset, doc_id, k, chunks, len(cut) // 4))
                    held.append(cut)
                    size += len(cut)
                    if size >= 1 << 22:
                        yield batch_of(rows, held)
                        rows, held, size = [], [], 0
                place, offset = place + 1, offset + n
        yield batch_of(rows, held)

    options = {
        "orc.stripe.size": stripe, "orc.create.index": "true", "orc.row.index.stride": STRIDE, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01,
        "orc.rows.between.memory.checks": 256,
    }
    rows.select("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**options).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files. Stripes are read in parallel; a filter on doc_id skips files, stripes and thousands of rows."""
    return spark.read.schema(SCHEMA).orc(path)


def of_documents(files: DataFrame, ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of some documents: few are named, so few stripes are read."""
    found = files.where(F.col("doc_id").isin(ids)).groupBy("part", "place", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("rows"))
    return found.select("doc_id", F.flatten(F.col("rows.ids")).alias("ids"))


def starts(files: DataFrame) -> DataFrame:
    """``part, base``: the number of ids in all files before each; as many rows as files, at most ``MOST_PARTS``."""
    totals = files.groupBy("part").agg(F.sum(F.col("n").cast("long")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), modulo that of CRC-32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(4096)
def _shift(n: int) -> int:
    """x ** (8 * n)."""
    out, power = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, power)
        power, n = _times(power, power), n >> 1
    return out


def crc_of(crcs, sizes) -> int:
    """The crc32 of texts one after another, from that of each and their lengths in bytes."""
    crc = 0
    for own, size in zip(crcs, sizes):
        crc = _times(_shift(int(size)), crc) ^ int(own)
    return crc


def digests(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from its ids as they stand in the files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("ids")
            values, bounds = np.ascontiguousarray(ids.values.to_numpy(), dtype="<u4"), ids.offsets.to_numpy()
            n = np.diff(bounds)
            crc = [zlib.crc32(memoryview(values[a:b]).cast("B")) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            kept = [batch.column(c) for c in ("part", "place", "offset", "doc_id", "chunk")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["part", "place", "offset", "doc_id", "chunk", "n", "crc"])

    @F.pandas_udf("long")
    def joined(rows):
        return rows.map(lambda r: r[0]["crc"] if len(r) == 1 else crc_of([x["crc"] for x in r], [4 * x["n"] for x in r]))

    ready(files.sparkSession)
    chunks = files.select("part", "place", "offset", "doc_id", "chunk", "ids").mapInArrow(run, "part int, place long, offset long, doc_id long, chunk int, n long, crc long")
    rows = chunks.groupBy("part", "place").agg(F.min("offset").alias("offset"), F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("chunk", "n", "crc"))).alias("rows"))
    rows = rows.join(F.broadcast(starts(files)), "part")
    return rows.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", joined("rows").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row of ``docs``: written by ``write_ids``, and read back.

    ``start`` counts the ids of all documents before it, by doc_id, null ids last; rows that share an id come in an order of
    their own. Null and empty texts are one end id long. Other columns are not read. No rows: no rows.
    """
    from whereabouts.session import checkpoint_dir

    path = f"{checkpoint_dir(docs.sparkSession)}/tables/{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end)
    return digests(read_ids(docs.sparkSession, path))
