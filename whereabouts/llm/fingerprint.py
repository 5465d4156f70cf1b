"""Document fingerprints from prefix arrays of polynomial hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, mixed, ready, saved

PRIME = (1 << 31) - 1
BASES = (1_000_003, 822_947_801)
SPAN = 16  # code points of the spans that are sampled
BINS = 64
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse, modulo the prime; doubled as far as any text has needed."""
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for base in [x for b in BASES for x in (b, pow(b, -1, PRIME))]:
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate((out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)))
            _tables.append(out)
    return _tables


class Prefix:
    """Prefix sums of ``code * base**place`` modulo a prime, for two bases: the hash of any span in constant time."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        values = codes.astype(np.uint64) + np.uint64(1)
        self.powers = _powers(self.n + 1)
        zero = np.zeros(1, np.uint64)
        self.sums = [np.concatenate((zero, np.cumsum(values * self.powers[2 * k][: self.n] % np.uint64(PRIME)) % np.uint64(PRIME))) for k in (0, 1)]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes that depend on what the spans hold, not on where they stand."""
        out = np.zeros(len(starts), np.uint64)
        for k in (0, 1):
            part = (self.sums[k][ends] + np.uint64(PRIME) - self.sums[k][starts]) % np.uint64(PRIME)
            out = out << np.uint64(31) | part * self.powers[2 * k + 1][starts] % np.uint64(PRIME)
        return out

    def span(self, start: int, end: int) -> int:
        out = 0
        for k in (0, 1):
            part = (int(self.sums[k][end]) - int(self.sums[k][start])) % PRIME
            out = out << 31 | part * int(self.powers[2 * k + 1][start]) % PRIME
        return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """How far the texts agree from ``a[i]`` and ``b[j]`` on, by binary search over span hashes."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def shared_start(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> int:
    """Length of the longest common prefix; texts of any length, a block of each at a time."""
    at = 0
    while True:
        x, y = a[at : at + block], b[at : at + block]
        found = common_extension(Prefix(x), 0, Prefix(y), 0)
        at += found
        if found < block:
            return at


def fingerprint(codes: np.ndarray, block: int = BLOCK) -> bytes:
    """8 bytes: hash of the whole text and its length; then 2 bytes for each bin of a sample of its spans.

    Of the hashes of all spans of 16 code points (of the whole text, if shorter) that fall into a bin, the least is kept,
    by its last 16 bits; an empty bin holds zeros and its flag in the last 8 bytes is not set.
    """
    least = np.full(BINS, EMPTY)
    whole = [0, 0]
    for at in range(0, len(codes), block):
        part = Prefix(codes[at : at + block + SPAN - 1])
        size = min(block, len(codes) - at)
        for k in (0, 1):
            whole[k] = (whole[k] + int(part.sums[k][size]) * pow(BASES[k], at, PRIME)) % PRIME
        last = min(size, part.n - SPAN + 1)
        if last > 0:
            starts = np.arange(last)
            h = mixed(part.spans(starts, starts + SPAN))
        elif at == 0:
            h = mixed(np.array([part.span(0, part.n)], np.uint64))
        else:
            continue
        np.minimum.at(least, (h >> np.uint64(58)).astype(np.int64), h)
    full = least != EMPTY
    sample = np.where(full, least & np.uint64(0xFFFF), 0).astype("<u2")
    total = (whole[0] << 31 | whole[1]) ^ (len(codes) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return total.to_bytes(8, "little") + sample.tobytes() + np.packbits(full).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of spans that two texts have in common (2 * both / (one + other)): 1 for equal fingerprints."""
    if a == b:
        return 1.0
    full_a, full_b = (np.unpackbits(np.frombuffer(x[-8:], np.uint8)).astype(bool) for x in (a, b))
    one, other = (np.frombuffer(x[8:-8], "<u2") for x in (a, b))
    either = int((full_a | full_b).sum())
    both = int((full_a & full_b & (one == other)).sum())
    shared = both / either if either else 0.0
    return 2 * shared / (1 + shared)


def edited(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last half replaced by the first code points, as many or all, of the following text."""
    half = len(codes) // 2
    return np.concatenate((codes[: len(codes) - half], following[:half]))


def _compare(codes: np.ndarray, mark: bytes, following: np.ndarray, next_mark: bytes) -> tuple:
    new = edited(codes, following)
    new_mark = fingerprint(new)
    data = new.tobytes().decode("utf-32-le").encode()
    return len(codes), hashlib.sha256(data).digest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark), shared_start(codes, new)


FIELDS = ("n_chars", "sha", "mark", "new_mark", "near_edited", "near_next", "shared_prefix")
RESULT = "n_chars long, sha binary, mark binary, new_mark binary, near_edited double, near_next double, shared_prefix long"


def with_next(docs: DataFrame, size: int = 2000) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    Next is by descending doc_id, then by text; after the last comes the first. Documents are dealt into runs of ids, of
    about ``size`` each, so each text is shuffled once, compressed; only the first text of each run goes to the run before.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shared_prefix`` for every
    row of ``docs (doc_id, text)``. Null texts count as empty; an empty text's fingerprint is like an empty one's (1) and
    unlike any other (0). A single document is its own next. Repeated rows follow each other. Null ids come last.
    Texts are hashed in blocks, whatever their length. No rows: no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    runs = max(1, ids.count() // size)
    edges = sorted({float(x) for x in ids.approxQuantile("doc_id", [i / runs for i in range(1, runs)], 0.1 / runs)}, reverse=True) if runs > 1 else []
    falling = -np.array(edges)  # run 0 has the largest ids

    def mark(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            none = batch["doc_id"].isna()
            run = np.searchsorted(falling, -pd.to_numeric(batch["doc_id"]).astype(float).fillna(0).to_numpy(), "right")
            run = np.where(none, len(edges) + 1, run)
            texts = [t or "" for t in batch["text"]]
            yield pd.DataFrame(
                {"run": run, "doc_id": batch["doc_id"], "mark": [fingerprint(codes_of(t)) for t in texts], "text": [press.compress(t.encode()) for t in texts]}
            )

    # ids travel as text, since a null among numbers would turn all of a batch into doubles
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(mark, "run int, doc_id string, mark binary, text binary")
    dealt = rows.repartition(max(1, (runs + 1) // 4), "run").sortWithinPartitions("run", F.col("doc_id").cast("long").desc_nulls_last(), "text")

    def pair(batches):
        opened = zstandard.ZstdDecompressor()
        held = None
        for batch in batches:
            out = []
            for run, doc_id, own, text in zip(batch["run"], batch["doc_id"], batch["mark"], batch["text"]):
                codes = codes_of(opened.decompress(text).decode())
                if held is None or held[0] != run:
                    if held is not None:
                        out.append((held[0], "tail", held[1], *[None] * 7, held[3], held[4]))
                    out.append((run, "head", doc_id, *[None] * 7, own, text))
                else:
                    out.append((run, "row", held[1], *_compare(held[2], held[3], codes, own), None, None))
                held = (run, doc_id, codes, own, text)
            yield frame(out)
        if held is not None:
            yield frame([(held[0], "tail", held[1], *[None] * 7, held[3], held[4])])

    def frame(rows):
        return pd.DataFrame(rows, columns=["run", "part", "doc_id", *FIELDS, "own", "text"]).astype({"n_chars": "Int64", "shared_prefix": "Int64"})

    found = saved(dealt.mapInPandas(pair, f"run int, part string, doc_id string, {RESULT}, own binary, text binary"))
    heads = found.where("part = 'head'").select("run", F.col("own").alias("next_own"), F.col("text").alias("next_text"))
    known = sorted(r[0] for r in heads.select("run").collect())
    after = dict(zip(known, known[1:] + known[:1]))
    after = spark.createDataFrame(list(after.items()), "run int, next int")
    tails = found.where("part = 'tail'").select("run", "doc_id", "own", "text").join(after, "run").join(heads.withColumnRenamed("run", "next"), "next")

    def last(batches):
        opened = zstandard.ZstdDecompressor()
        read = lambda x: codes_of(opened.decompress(x).decode())
        for batch in batches:
            out = [(d, *_compare(read(t), o, read(u), p)) for d, o, t, p, u in zip(*[batch[c] for c in ("doc_id", "own", "text", "next_own", "next_text")])]
            yield pd.DataFrame(out, columns=["doc_id", *FIELDS])

    ends = tails.select("doc_id", "own", "text", "next_own", "next_text").mapInPandas(last, f"doc_id string, {RESULT}")
    both = found.where("part = 'row'").select("doc_id", *FIELDS).unionByName(ends)
    low = lambda c: F.lower(F.hex(c))
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_chars", low("sha").alias("edited_sha256"), low("mark").alias("fingerprint"), low("new_mark").alias("edited_fingerprint"),
        "near_edited", "near_next", "shared_prefix",
    )
