"""SentencePiece encoding and decoding of merge-type models, exactly, by backtracking over longest matches."""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_texts, ready

SPACE = "▁"
TAIL = ",.!?%*&#$|;:"
KEPT = 650_000  # words whose ids a worker keeps, in each of two generations
KEPT_CHARS = 1 << 25  # and the characters that they have in all
LONG = 256  # longer words are not kept
RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_coders: dict[str, "Coder"] = {}

codecs.register_error("each byte", lambda e: ("�" * (e.end - e.start), e.end))


class Coder:
    """A model file read once a worker: pieces by rank, an automaton of them, and what is known of adjacent pieces.

    Rank 0 and on are single characters, then merges in the order in which the model makes them.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ids = range(size)
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.end = model.eos_id()
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        order = sorted(normal, key=lambda i: (len(model.id_to_piece(i)) > 1, -model.get_score(i), i))
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.code = "H" if size <= 1 << 16 else "I"
        self.id = [*order]
        self.piece = [model.id_to_piece(i) for i in order]
        self.rank = {p: r for r, p in enumerate(self.piece)}
        self.characters = {p for p in self.piece if len(p) == 1}
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        valid = [self._split(r) for r in range(len(order))]
        self.length = [len(p) for p in self.piece]
        self.pairs = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.parted = not any(p[1] == SPACE and p[0] != SPACE for p in self.pairs) and not any("\n" in p for p in self.piece)
        reachable = {p for p, ok in zip(self.piece, valid) if ok}
        self.shorter = [next((self.rank[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reachable), -1) for p in self.piece]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, self.rank[p])
        self.automaton.make_automaton()
        self.known_pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        texts = [model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for i in ids:
            if model.is_byte(i):
                texts[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif model.is_control(i):
                texts[i] = b""
            elif model.is_unknown(i):
                texts[i] = " ⁇ ".encode()
        self.texts = Table(texts)
        self.digits = Table([f" {i}".encode() for i in ids])
        self.marked = np.array([model.id_to_piece(i).startswith(SPACE) for i in ids])
        self.silent = np.array([model.is_control(i) for i in ids])

    def _split(self, rank: int) -> bool:
        """Merges a piece's characters alone; notes its last merge, and whether they end up as this piece."""
        parts = list(self.piece[rank])
        if len(parts) == 1:
            return True
        if any(c not in self.rank for c in parts):
            return False
        while len(parts) > 2:
            best = min((self.rank.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 30:
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        self.left[rank], self.right[rank] = self.rank[parts[0]], self.rank[parts[1]]
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether two adjacent pieces stay apart: undoes their merges from the latest back, and looks at each stage for a
        merge across the boundary that would have come first."""
        key = a << 32 | b
        known = self.known_pairs.get(key)
        if known is None:
            if len(self.known_pairs) > 4_000_000:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        rank, piece, left, right = self.rank, self.piece, self.left, self.right
        limit = 1 << 40
        while True:
            across = rank.get(piece[a] + piece[b])
            if across is not None and across < limit:
                return False
            first_a = a > b
            for undo_a in (first_a, not first_a):
                if undo_a:
                    limit = a
                    if right[a] != a:
                        a = right[a]
                        break
                else:
                    limit = b + 1
                    if left[b] != b:
                        b = left[b]
                        break
            else:
                return True

    def backtrack(self, text: str) -> list[int]:
        """Ranks of a text of known characters: the longest match that fits the piece before; places where none fits are
        marked in a bitfield and never entered again."""
        n = len(text)
        longest = [0] * n
        length, shorter, known = self.length, self.shorter, self.known_pairs
        for end, r in self.automaton.iter(text):
            longest[end + 1 - length[r]] = r
        failed = bytearray((n >> 3) + 1)  # a bit for each place
        out: list[int] = []
        at, last, now = 0, -1, longest[0]
        while True:
            end = at + length[now]
            if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or known.get(last << 32 | now) or self.compatible(last, now)):
                out.append(now)
                at, last = end, now
                if at == n:
                    return out
                now = longest[at]
                continue
            now = shorter[now]
            while now < 0:
                failed[at >> 3] |= 1 << (at & 7)
                now = out.pop()
                at -= length[now]
                last = out[-1] if out else -1
                now = shorter[now]

    def unit(self, text: str) -> bytes:
        """Ids of a part of a text across whose ends nothing merges; unknown characters become bytes."""
        if self.characters.issuperset(text):
            return array(self.code, map(self.id.__getitem__, self.backtrack(text))).tobytes() if text else b""
        out: list[int] = []
        for known, run in groupby(text, self.characters.__contains__):
            run = "".join(run)
            out += [self.id[r] for r in self.backtrack(run)] if known else [self.byte[b] for b in run.encode()]
        return array(self.code, out).tobytes()

    def learn(self, words: set[str], fresh: bool = True) -> None:
        """Keeps the ids of words. Characters that no piece holds side by side part a word further."""
        self.held += sum(map(len, words))
        if fresh and (len(self.words) > KEPT or self.held > KEPT_CHARS):
            self.older, self.words, self.held = self.words, {}, 0
        for w in words:
            ids = self.older.get(w)
            if ids is None:
                head = w.rstrip(TAIL)
                if head and head != w and head[-1] + w[len(head)] not in self.pairs:
                    ids = self._one(head) + self._one("\n" + w[len(head) :])[len(self.newline) :]
                else:
                    ids = self._fresh(w)
            self.words[w] = ids

    def _one(self, w: str) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            ids = self.words[w] = self.older[w] if w in self.older else self._fresh(w)
        return ids

    def _fresh(self, w: str) -> bytes:
        return self.unit(w if w[:1] in ("\n", SPACE) else SPACE + w)

    @property
    def newline(self) -> bytes:
        return self._one("\n")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without an end id. The text is parted before each blank that follows something else, and
        around newlines, where no piece can reach across."""
        split = []
        for t in texts:
            t = t.replace(SPACE, " ")
            if not self.parted or "  " in t or t[:1] == " ":
                split.append(RUNS.findall((SPACE + t).replace(" ", SPACE)) if self.parted else [(SPACE + t).replace(" ", SPACE)])
            else:
                split.append(t.replace("\n", " \n").split(" "))
        out = []
        for at in range(0, len(texts), 100):
            part, known = split[at : at + 100], self.words
            new = {w for s in part for w in s if w not in known}
            if new:
                self.learn(new)
                if self.words is not known:
                    self.learn({w for s in part for w in s if w not in self.words}, False)
            known = self.words
            out += [np.frombuffer(b"".join(map(known.__getitem__, s)) if t else b"", dtype=self.kind) for t, s in zip(texts[at : at + 100], part)]
            for w in new:
                if len(w) > LONG:  # hardly ever met again
                    known.pop(w, None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the first piece loses the blank that encoding put before it."""
        data = self.texts.joined(ids)
        heard = np.flatnonzero(~self.silent[ids])
        if len(heard) and self.marked[ids[heard[0]]]:
            data = data[1:]
        return data.decode("utf-8", "each byte")


class Table:
    """Byte strings that are looked up and joined without a loop."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), dtype=np.uint8)
        self.size = np.array([len(x) for x in items], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), 1 << 17):
            part = ids[at : at + (1 << 17)]
            size = self.size[part]
            shift = self.start[part] - (np.cumsum(size) - size)
            out.append(self.data[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encoded(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs (doc_id, text)``, with the model's end id last."""

    def run(texts):
        library = coder(model)
        ids = [x.astype(np.int32) for x in library.encode([t or "" for t in texts])]
        return pd.Series([np.append(x, np.int32(library.end)) if end else x for x in ids], dtype=object)

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), on_texts(F.col("text"), run, "array<int>").alias("ids"))


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of rows ``(doc_id, ids)``; null ids give a null text, no ids an empty one."""

    def run(ids):
        library = coder(model)
        return pd.Series([None if x is None else library.decode(np.asarray(x, dtype=np.int64)) for x in ids], dtype=object)

    ready(rows.sparkSession)
    return rows.select("doc_id", on_texts(F.col("ids"), run, "string").alias("text"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``: encodes with an end id, decodes, digests.

    Null and empty texts have the end id alone and decode to an empty text. Very long texts are encoded whole. Repeated
    rows come back as often. A literal U+2581 decodes to a blank, as in the library. No rows: no rows.
    """

    def run(texts):
        library = coder(model)
        end = np.array([library.end], dtype=library.kind)
        rows = []
        for ids in library.encode([t or "" for t in texts]):
            ids = np.concatenate((ids, end))
            written = hashlib.sha256(library.digits.joined(ids)[1:]).hexdigest()
            rows.append((len(ids), written, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    ready(docs.sparkSession)
    made = on_texts(F.col("text"), run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), made.alias("made")).select("doc_id", "made.*")
