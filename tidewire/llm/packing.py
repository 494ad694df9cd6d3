"""Sum-of-squares online packing of token ids into windows of ``size`` tokens.

Each document's ids (with the end id) are cut into whole windows and a rest. The rest goes, as it comes, to the fill level
that minimises the sum of squared counts of partially filled windows: putting ``s`` tokens on level ``h`` takes one window
from count ``N[h]`` and adds one to ``N[h + s]`` (level 0 is a new window, level ``size`` is a full one, neither is counted).
``N`` is the level array, of one entry for each fill. Every input partition packs its own documents, so nothing is shuffled
and the work spreads with the input; a retried task packs the same rows in the same order.

At the end of a partition no new window is opened: each open window in turn, the emptiest first, is emptied and its tokens are
placed as one fragment, by the same rule and whole, into another. Windows that no other has room for (fuller than half, mostly)
are laid end to end, the fullest first, and cut into whole windows; what is left over is cut into sequences of powers of two, which need
no padding. Some length mixes leave ever more open windows: beyond ``most_open`` of them in a task (4 KB of ids each) the same is
done at once, so that a task's memory doesn't grow with its rows; no token is lost or padded by that.

Defined results: a null or empty text is its end id alone; rows are packed one by one, so repeated rows and null ids are
packed as they come; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import table
from tidewire.llm.tokenizing import BYTE_BPE, encoder

PIECE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
    + [T.StructField("ids", T.BinaryType())]
)


_NO = int(np.iinfo(np.int64).max)


class Packer:
    """Pieces are (doc_id, start, ids as bytes, doc_tokens); ``out`` gets them with their sequence and offset."""

    def __init__(self, size: int, first_sequence: int, most_open: int) -> None:
        self.size, self.next, self.most = size, first_sequence, most_open
        self.counts = np.zeros(size + 1, np.int64)  # N, for levels 1 to size - 1
        self.windows: list[list[list]] = [[] for _ in range(size + 1)]  # by level; a window is its list of pieces
        self.n_open = 0
        self.out: list[tuple] = []

    def _close(self, window: list) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in window:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, doc_tokens, self.next, at, ids))
            at += n
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        n, step = len(ids) // 4, 4 * self.size
        rest = n // self.size * self.size
        for k in range(0, 4 * rest, step):
            self._close([(doc_id, k // 4, ids[k : k + step], n)])
        if n > rest:
            self._place(n - rest, (doc_id, rest, ids[4 * rest :], n))

    def _level(self, s: int) -> tuple[int, int]:
        """The level of an open window to put s tokens on (0: none has room), and what the sum of squares gains by it."""
        counts, size = self.counts, self.size
        gain = 2 * (counts[1 + s :] - counts[1 : size - s + 1]) + 2  # on each level from 1
        if not len(gain):
            return 0, _NO
        gain[-1] = 1 - 2 * counts[size - s]  # a full window leaves the sum
        gain[counts[1 : size - s + 1] == 0] = _NO
        k = len(gain) - 1 - int(np.argmin(gain[::-1]))  # of equal levels the fullest
        return (k + 1, int(gain[k])) if gain[k] < _NO else (0, _NO)

    def _place(self, s: int, piece: tuple) -> None:
        counts, size = self.counts, self.size
        level, gain = self._level(s)
        if gain > 2 * counts[s] + 1:
            level = 0
        window: list = []
        if level:
            window = self._take(level)
        window.append(piece)
        if level + s == size:
            self._close(window)
        else:
            self._open(level + s, window)
            if self.n_open > self.most:
                self._open_again(self._drain())

    def _open(self, level: int, window: list) -> None:
        self.windows[level].append(window)
        self.counts[level] += 1
        self.n_open += 1

    def _open_again(self, rest: list) -> None:
        if rest:
            self._open(sum(len(p[2]) // 4 for p in rest), rest)

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.windows[level].pop()

    def _merge(self) -> None:
        """Place open windows into each other, the emptiest first, while one has room for another."""
        for s in range(1, self.size):
            while self.counts[s]:
                moved = self._take(s)
                level, _ = self._level(s)
                if not level:
                    self._open(s, moved)
                    break
                window = self._take(level) + moved
                if level + s == self.size:
                    self._close(window)
                else:
                    self._open(level + s, window)

    def _drain(self) -> list:
        """Merge open windows, lay the others end to end, close what is whole, and return the rest as one window."""
        self._merge()
        waiting = [w for ws in self.windows for w in ws]  # emptiest first
        pieces = [p for w in waiting for p in reversed(w)]
        self.counts[:] = 0
        self.windows = [[] for _ in range(self.size + 1)]
        self.n_open = 0
        pieces.reverse()
        window, room = [], self.size
        for doc_id, start, ids, total in pieces:
            while ids:
                cut = ids[: 4 * room]
                window.append((doc_id, start, cut, total))
                start, ids, room = start + len(cut) // 4, ids[4 * room :], room - len(cut) // 4
                if not room:
                    self._close(window)
                    window, room = [], self.size
        return window

    def finish(self) -> None:
        rest = self._drain()
        total = sum(len(p[2]) // 4 for p in rest)
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            room, window = 1 << bit, []
            while room:
                doc_id, start, ids, n = rest.pop(0)
                cut = ids[: 4 * room]
                window.append((doc_id, start, cut, n))
                if len(ids) > len(cut):
                    rest.insert(0, (doc_id, start + room, ids[len(cut) :], n))
                room -= len(cut) // 4
            self._close(window)


def pack_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0, tokenizer: str = BYTE_BPE, tokenizer_path: str | None = None, most_open: int = 4096) -> DataFrame:
    """A row for each piece: document, start, ids (little-endian unsigned 32-bit), sequence and offset there."""
    end = np.array([end_id], "<u4").tobytes()

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=PIECE.names).astype({"doc_id": "Int64"})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, tokenizer_path)
        packer = Packer(size, TaskContext.get().partitionId() << 40, most_open)
        for pdf in batches:
            for doc_id, t in zip(pdf["k"].astype("Int64"), pdf["t"]):
                packer.add(None if doc_id is pd.NA else doc_id, enc.encode(t) + end)
                if len(packer.out) >= 2000:
                    yield frame(packer.out)
                    packer.out = []
        packer.finish()
        if packer.out:
            yield frame(packer.out)

    return docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).mapInPandas(packed, PIECE)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_with_digests(pack_documents(table(spark, sf_dir, "documents")))


def pieces_with_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
