"""Packing token streams into training windows by minimum bin slack.

A task encodes its documents, cuts off full windows, and keeps what remains in a pool. For each further window a
bitset subset-sum over the pool's lengths (as a multiset, counts split into powers of two) finds the sum closest to
the capacity beside the longest remainder; backtracking gives the count of each length. Slack that no multiset can
fill is closed by cutting one more remainder, so only the last tokens of a task are no full window: they become
windows whose sizes are powers of two, which need no padding. There is no shuffle and no state beyond the pool.

Defined results: null text is empty (the end id alone); rows with equal doc_ids are packed apart; a null doc_id
stays null; an empty table gives no pieces; further columns are ignored. Sequence ids are unique, not dense.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokenizing import encoder, with_end

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_subset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as large as possible, at most capacity.

    counts: available remainders by length. Longer lengths come first, so ties take few, long pieces.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, k = left - take, k * 2
            if reach >> capacity & 1:
                break
        if reach >> capacity & 1:
            break
    total, out = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] += take
            total -= length * take
    return dict(out)


class Packer:
    """Takes documents, gives back pieces (item, start, length, sequence, offset)."""

    def __init__(self, window: int, pool: int):
        self.window, self.pool = window, pool
        self.by_length: dict[int, deque] = defaultdict(deque)
        self.waiting, self.tokens, self.sequence = 0, 0, 0
        self.out: list[tuple] = []

    def add(self, item, n: int) -> None:
        start = 0
        while n - start >= self.window:
            self.out.append((item, start, self.window, self.sequence, 0))
            self.sequence += 1
            start += self.window
        if n > start:
            self._keep(item, start, n - start)
        while self.waiting > self.pool and self.tokens >= self.window:
            self._fill()

    def _keep(self, item, start: int, length: int) -> None:
        self.by_length[length].append((item, start))
        self.waiting, self.tokens = self.waiting + 1, self.tokens + length

    def _take(self, length: int):
        queue = self.by_length[length]
        item = queue.popleft()
        if not queue:
            del self.by_length[length]
        self.waiting, self.tokens = self.waiting - 1, self.tokens - length
        return item

    def _put(self, item, start: int, length: int, at: int) -> int:
        self.out.append((item, start, length, self.sequence, at))
        return at + length

    def _fill(self) -> None:
        """One full window; the pool holds enough tokens."""
        longest = max(self.by_length)
        item, start = self._take(longest)
        at = self._put(item, start, longest, 0)
        chosen = best_subset({n: len(q) for n, q in self.by_length.items()}, self.window - at)
        for length, count in chosen.items():
            for _ in range(count):
                item, start = self._take(length)
                at = self._put(item, start, length, at)
        self._close(at, self.window)

    def _close(self, at: int, size: int) -> None:
        """Fills the sequence up to size by cutting remainders, longest first."""
        while at < size:
            length = max(self.by_length)
            item, start = self._take(length)
            part = min(length, size - at)
            at = self._put(item, start, part, at)
            if length > part:
                self._keep(item, start + part, length - part)
        self.sequence += 1

    def finish(self) -> None:
        while self.tokens >= self.window:
            self._fill()
        while self.tokens:
            self._close(0, 1 << (self.tokens.bit_length() - 1))


def _pack(path: str, end: int, window: int, pool: int, id_col: str, text_col: str, specials: bool = False) -> Callable:
    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        enc, packer = encoder(path, specials=specials), Packer(window, pool)

        def flush():
            out, packer.out = packer.out, []
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0][0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([len(x[0][1]) for x in out], pa.int64()),
                    pa.array([first + x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int64()), pa.array([x[0][1][x[1] : x[1] + x[2]].astype("<u4").tobytes() for x in out], pa.binary()),
                ], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch, texts in slices(batches, text_col):
            ids, counts, _ = enc.encode(texts)
            ids, counts = with_end(ids, counts, end)
            ids = ids.astype(np.uint16 if enc.dtype.itemsize == 2 and end < 65536 else np.uint32)
            ends = np.cumsum(counts)
            docs = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            for doc, a, b in zip(docs, (ends - counts).tolist(), ends.tolist(), strict=True):
                packer.add((doc, ids[a:b].copy()), b - a)  # a copy: the batch may go while a remainder waits
                if len(packer.out) >= 4096:
                    yield from flush()
            yield from flush()
        packer.finish()
        yield from flush()

    return run


def pack(docs: DataFrame, tokenizer: str, end: int, window: int = 2048, pool: int = 512, id_col: str = "doc_id", text_col: str = "text", specials: bool = False) -> DataFrame:
    """Pieces of all documents: where they lie in their document and in their sequence, and their ids (32-bit, little-endian).

    A window must be a power of two. pool: remainders that wait at once; more give the search more to choose from.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(_pack(tokenizer, end, window, pool, "doc_id", "text", specials), PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a crc32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
