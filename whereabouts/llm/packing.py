"""Best-fit packing of tokenized documents, improved by swaps between underfull sequences."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_texts, ready

CAPACITY = 2048
SEPARATOR = 0
SHARD = 4096
# Fixed value: how byte-level BPE parts a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    The file's vocabulary and merge order are read once a worker into tiktoken's merger, which has the same ids at a
    fraction of the time; a text that holds the string of a special token goes to the library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        # Byte-level BPE writes bytes that are no visible character as the characters from 256 on, in order.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the separator, cut where longer than a sequence.

    Of a longer document the first piece holds the remainder, so that all others fill a sequence.
    """
    end = np.array([separator], dtype="<u4").tobytes()

    def run(texts):
        library = encoder(tokenizer)
        rows = []
        for text in texts:
            ids = library.ids(text or "") + end
            n = len(ids) // 4
            first = n if n <= capacity else n % capacity or capacity
            cuts = [0, *range(first, n, capacity), n]
            rows.append((cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:])], [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]))
        return pd.DataFrame(rows, columns=["start", "length", "ids_crc32"])

    ready(docs.sparkSession)
    made = on_texts(F.col("text"), run, "struct<start:array<bigint>,length:array<bigint>,ids_crc32:array<bigint>>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), made.alias("made"))
    return rows.select("doc_id", F.posexplode(F.arrays_zip("made.start", "made.length", "made.ids_crc32")).alias("piece", "x")).select("doc_id", "piece", "x.*")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers by best-fit decreasing; rooms are found by the bits of one integer."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        left = room - size
        by_room[left].append(at)
        rooms |= 1 << left
    return bins


def improve(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Swap-based local search: the emptiest bin gives single documents or pairs to fuller underfull bins, for nothing or
    for one shorter document. Each step moves fill to the fuller bin, so the sum of squared fills rises; of the possible
    steps the one that leaves the least room in the fuller bin is taken. A bin that ends up empty goes; one that can give
    nothing more stays as it is."""
    fill = np.array([int(lengths[b].sum()) for b in bins])
    live = [i for i in np.argsort(fill, kind="stable").tolist() if fill[i] < capacity]
    items = np.array([x for i in live for x in bins[i]], dtype=np.int64)
    home = np.array([i for i in live for _ in bins[i]], dtype=np.int64)
    none = np.array(live, dtype=np.int64)
    # Candidates: every item of an underfull bin, and one empty exchange for each such bin.
    size = np.concatenate((lengths[items], np.zeros(len(none), np.int64))) if len(items) else np.zeros(0, np.int64)
    home, room = np.concatenate((home, none)), capacity - fill
    closed: set[int] = set()
    while True:
        open_ = [i for i in live if i not in closed and fill[i] > 0]
        if len(open_) < 2:
            break
        giver = min(open_, key=lambda i: (fill[i], i))
        while fill[giver] > 0:
            own = np.flatnonzero((home[: len(items)] == giver))
            singles = [(int(k),) for k in own]
            pairs = [(int(own[x]), int(own[y])) for x in range(len(own)) for y in range(x + 1, len(own))]
            left = room[home]
            fuller = (home != giver) & (fill[home] >= fill[giver]) & (fill[home] < capacity)
            best = None
            for out in singles + pairs:
                gain = int(size[list(out)].sum()) - size
                fits = fuller & (gain > 0) & (gain <= left)
                at = np.flatnonzero(fits)
                if len(at):
                    key = (left[at] - gain[at]) * (2 * capacity) - gain[at]
                    k = int(key.argmin())
                    if best is None or key[k] < best[0]:
                        best = (int(key[k]), out, int(at[k]))
            if best is None:
                break
            _, out, at = best
            taker, gain = int(home[at]), int(size[list(out)].sum() - size[at])
            for k in out:
                home[k] = taker
            if at < len(items):
                home[at] = giver
            fill[taker] += gain
            fill[giver] -= gain
            room[taker] -= gain
            room[giver] += gain
        closed.add(giver)
    packed: dict[int, list[int]] = {i: [] for i in live}
    for item, at in zip(items.tolist(), home.tolist()):
        packed[at].append(item)
    whole = set(live)
    return [b for i, b in enumerate(bins) if i not in whole] + [packed[i] for i in live if packed[i]]


def pack_shard(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there."""
    bins = improve(lengths, best_fit(lengths, capacity), capacity)
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(bins):
        at[items] = number
        offset[items] = np.concatenate(([0], np.cumsum(lengths[items])[:-1]))
    return at, offset


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, shard: int = SHARD) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs``.

    Pieces are dealt by a hash into shards of about ``shard`` documents, each packed on its own; a shard leaves about one
    sequence underfull, so what this costs does not grow with the data. Only numbers are shuffled, never texts or ids.

    Null and empty texts are one separator long. Repeated rows are packed as often. A document longer than a sequence
    fills whole ones but for its first piece. No rows: no rows. ``sequence_id`` is the shard times 2**32 plus a count.
    """
    shards = max(1, math.ceil(docs.count() / shard))
    rows = pieces(docs, tokenizer, capacity, separator).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        at, offset = pack_shard(group["length"].to_numpy(np.int64), capacity)
        group["sequence_id"] = group["shard"].to_numpy(np.int64) * (1 << 32) + at
        group["offset"] = offset
        return group.drop(columns=["shard"])

    # ids travel as text, since a null among numbers would turn all of a group into doubles
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rows.groupBy("shard").applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
