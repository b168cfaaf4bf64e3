"""Benchmark decontamination: which documents contain which benchmark items.

Containment of an item in a document is the share of the item's distinct word shingles (five words unless told
otherwise, fewer words make one shingle) that occur in the document. An item is short and a document may be long, so
MinHash of whole documents cannot show it. Items are therefore partitioned by size, a document is covered by
overlapping windows of one and a half times the size of each partition, and an item is a candidate where one of its
MinHash values is that of a window (each hash function is a band of its own). A contiguous occurrence with
containment 0.8 has a Jaccard similarity of at least 0.25 with some window, so with 64 functions it is missed with a
chance of 1e-8. Every candidate is verified by exact shingle containment over the whole document.

An item that repeats itself has far fewer shingles than places, so that its windows would be much wider than its set:
of such items (less than half as many) enough shingles are looked up exactly that any document which contains 0.8 of
them holds one. An item whose shingles lie scattered over a long document is found with a lower probability.

The benchmark is the stated query set: its different texts are handled in blocks of about `block` items and
`BLOCK_BYTES` bytes at most, each broadcast and matched against all documents; equal items are matched once.

Defined results: null or wordless texts and items contain nothing and are contained in nothing; an item of fewer words
than a shingle is contained in documents of just these words; rows with equal ids are matched apart; texts of any
length are read whole; an empty table gives no rows; further columns are ignored or, in a filter, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices
from .shingles import PLACE_KEYS, STEP, mix64, word_hashes

#: MinHash functions: odd factors and offsets on 32 bits.
FUNCTIONS = 64
_rng = np.random.default_rng(977)
FACTORS = (_rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
OFFSETS = _rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)
#: Items and bytes of items handled in one pass.
BLOCK, BLOCK_BYTES = 20_000, 16 << 20


def rolling(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes at all word positions of the texts, and their number in each text."""
    words, counts = word_hashes(texts)
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    roll = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        roll += words[j : j + len(roll)] * PLACE_KEYS[j]
    roll = mix64(roll)
    first = np.cumsum(counts) - counts
    take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    short = np.flatnonzero((counts > 0) & (counts < n))
    out = roll[np.minimum(take, max(0, len(roll) - 1))] if len(roll) else np.zeros(len(take), np.uint64)
    at = np.cumsum(size) - size
    for i in short:
        w = words[first[i] : first[i] + counts[i]]
        out[at[i]] = mix64(np.array([(w * PLACE_KEYS[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64) ^ STEP)[0]
    return out, size


class Index:
    """A block of items by size partition: MinHash values to items, and their exact shingles."""

    def __init__(self, ids: list, texts: list, n: int, percent: int):
        self.n, self.percent, self.ids = n, percent, ids
        rolls, size = rolling(pa.array([t or "" for t in texts], pa.string()), n)
        ends = np.cumsum(size)
        self.sets = [np.unique(rolls[e - s : e]) for s, e in zip(size, ends, strict=True)]
        by_step: dict[int, list[int]] = {}
        exact: list[tuple[int, int]] = []  # shingles of items that repeat themselves
        for i, s in enumerate(size.tolist()):
            own = self.sets[i]
            if 2 * len(own) < s:
                exact += [(int(x), i) for x in own[: len(own) - -(-percent * len(own) // 100) + 1]]
            elif s:
                by_step.setdefault(max(2, 1 << (s - 1).bit_length()) // 2, []).append(i)
        exact.sort()
        self.exact = np.array([x for x, _ in exact], np.uint64), np.array([i for _, i in exact], np.int64)
        self.classes = []  # (window step, for each function: prefilter, sorted values, items)
        for step, items in sorted(by_step.items()):
            lows = [self.sets[i].astype(np.uint32) for i in items]
            tables = []
            for f, o in zip(FACTORS, OFFSETS, strict=True):
                least = np.array([(x * f + o).min() for x in lows], np.uint32)
                order = np.argsort(least, kind="stable")
                seen = np.zeros(65536, bool)
                seen[least >> 16] = True
                tables.append((seen, least[order], np.array(items)[order]))
            self.classes.append((step, tables))

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) with enough containment."""
        rolls, size = rolling(texts, self.n)
        if not len(rolls) or not self.classes and not len(self.exact[0]):
            return []
        low, ends = rolls.astype(np.uint32), np.cumsum(size)
        pairs: set[tuple[int, int]] = set()
        if len(self.exact[0]):
            at, upto = (np.searchsorted(self.exact[0], rolls, side) for side in ("left", "right"))
            for h in np.flatnonzero(upto > at).tolist():
                pairs.update((int(np.searchsorted(ends, h, "right")), int(x)) for x in self.exact[1][at[h] : upto[h]])
        for k in range(FUNCTIONS):
            level, width = low * FACTORS[k] + OFFSETS[k], 1
            for step, tables in self.classes:
                while width < step:
                    if len(level) % 2:
                        level = np.append(level, np.uint32(2**32 - 1))
                    level, width = np.minimum(level[::2], level[1::2]), width * 2
                # three neighbouring blocks; the last windows are shorter
                windows = level.copy()
                np.minimum(windows[:-1], level[1:], out=windows[:-1])
                if len(level) > 2:
                    np.minimum(windows[:-2], level[2:], out=windows[:-2])
                seen, values, items = tables[k]
                hits = np.flatnonzero(seen[windows >> 16])
                if not len(hits):
                    continue
                at = np.searchsorted(values, windows[hits])
                upto = np.searchsorted(values, windows[hits], "right")
                for h, i, j in zip(hits[upto > at].tolist(), at[upto > at].tolist(), upto[upto > at].tolist(), strict=True):
                    # a window may reach over the border of texts: each of them is a candidate
                    a = int(np.searchsorted(ends, h * step, "right"))
                    b = int(np.searchsorted(ends, min(len(rolls), (h + 3) * step) - 1, "right"))
                    pairs.update((t, int(x)) for t in range(a, b + 1) for x in items[i:j])
        out, text, own = [], None, None
        for t, x in sorted(pairs):
            if t != text:
                text, own = t, np.unique(rolls[ends[t] - size[t] : ends[t]])
            item = self.sets[x]
            where = np.searchsorted(own, item)
            where[where == len(own)] = 0
            common = int((own[where] == item).sum()) if len(own) else 0
            if 100 * common >= self.percent * len(item):
                out.append((t, x, common))
        return out


def _keyed(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, text, key: equal texts have equal keys."""
    rows = bench.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.withColumn("key", F.md5("text"))


def _blocks(keyed: DataFrame, n: int, percent: int, block: int) -> Iterator[Index]:
    """The different texts of the benchmark in blocks; each is small whatever the table's size."""
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # half of the limit on average, as a hash deals them
    many = max(-(-total.n // block), -(-2 * total.bytes // BLOCK_BYTES))
    for i in range(many):
        part = texts.where(F.pmod(F.xxhash64("key"), F.lit(many)) == i).collect()
        yield Index([r.key for r in part], [r.text for r in part], n, percent)


def _pairs(index: Index) -> Callable:
    def run(batches):
        for batch, texts in slices(batches, "text"):
            got = index.matches(texts)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array([t for t, _, _ in got], pa.int64())), pa.array([index.ids[x] for _, x, _ in got], pa.string()), pa.array([c for _, _, c in got], pa.int64()), pa.array([len(index.sets[x]) for _, x, _ in got], pa.int64()),
            ], names=["doc_id", "key", "n_common", "n_item"])

    return run


def contaminated(docs: DataFrame, bench: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_common, n_item, containment: each document and item of which it contains enough."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed, out = _keyed(bench, item_col, item_text_col), None
    for index in _blocks(keyed, n, percent, block):
        part = cols.mapInArrow(_pairs(index), "doc_id long, key string, n_common long, n_item long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, key string, n_common long, n_item long")
    named = out.join(keyed.select("key", "item_id"), "key").select("doc_id", "item_id", "n_common", "n_item")
    return named.withColumn("containment", F.col("n_common") / F.col("n_item"))


def _clean(index: Index, text: str, drop: bool) -> Callable:
    def run(batches):
        for batch, texts in slices(batches, text):
            keep = np.ones(batch.num_rows, bool)
            keep[[t for t, _, _ in index.matches(texts)]] = False
            out = batch.filter(pa.array(keep))
            yield out.drop_columns([text]) if drop else out

    return run


def remove_contaminated(docs: DataFrame, bench: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    probe = fresh(docs.columns, "probe_text")
    for index in _blocks(_keyed(bench, item_col, item_text_col), n, percent, block):
        schema = docs.schema
        docs = docs.withColumn(probe, F.col(text_col).cast("string")).mapInArrow(_clean(index, probe, True), schema)
    return docs

