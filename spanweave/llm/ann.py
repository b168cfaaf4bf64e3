"""Approximate nearest neighbours by largest inner product: inverted lists of coarse centroids with product-quantised
residuals, asymmetric distance tables, and exact reranking.

Fit: coarse centroids and residual codebooks come from at most `sample` rows (least by a hash of their id). There are
about as many lists as the root of the number of rows: where the sample is too small for that many centroids, a second
set of centroids, of what the first leaves, divides each list. The share of lists that a search visits is the least one
that holds `target` of the neighbours in the sample (as many of them as stand for the k nearest of all rows); lists go
by the score of their centroid and by how far their rows lie around it. Every row is indexed. The index is a table in
the shared folder: list, id, code, vector (in the column's own precision).

Search: lists near to each other share a bin of bounded size, a long list takes several bins, and queries go only to
the bins of the lists they visit, in slices of bounded size; a bin comes to each slice. A bin's rows come first and stay
in memory, then queries stream past: the distance tables of a query score the rows of its lists, those that may be among
the k best of the bin within the quantisation error (`rerank` at least) are scored exactly in double precision, and the
best k of each bin go to the final ranking. Queries are a column of ids of the table itself; a query's own id is no
candidate. Queries are a fixed share of all rows, so the work is their number times the rows they visit.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components take
no part; rows with a null id take no part; equal vectors tie and go by id; a query with fewer than k candidates gets
all; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import list_array, mix64, staged

#: Rows of the fit, of them for each centroid; bytes of a bin's vectors, bins at least, queries of a slice, scores held at once.
SAMPLE, CENTROID_ROWS, BIN_BYTES, LEAST_BINS, SLICE_QUERIES, SCORES = 20_000, 16, 16 << 20, 16, 50_000, 4 << 20
#: Widths (in spreads of a list's rows) by which lists may be raised in the order of visits; the fit chooses one.
WIDTHS = (0.0, 1.0, 2.0, 3.0)
#: Quantisation errors (of usual size) by which a row may be better than its approximate score.
MARGIN = np.float32(2.5)
INDEX = "list int, id long, code binary, vector binary"
ROWS = "bin int, query int, id long, list int, code binary, vector binary, probes array<int>"


def matrix(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part as a double matrix, and which rows of the column they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    ends = np.cumsum(size)
    ok = size == (dim if dim is not None else 0)
    if flat.null_count:
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        ok &= holes[ends] == holes[ends - size]
    rows = np.flatnonzero(ok)
    if not dim or not len(rows):
        return np.zeros((0, dim or 0)), np.zeros(0, np.int64)
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    x = values[(ends[rows] - size[rows])[:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[good], rows[good]


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of Lloyd's rounds from a seeded start; an empty cluster starts again at a random row."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.stack([np.bincount(a, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Quantiser:
    dim: int
    kind: str  # the type of stored components
    first: np.ndarray
    second: np.ndarray  # centroids of what the first leave: list i * len(second) + j
    cuts: list[np.ndarray]  # the dimensions of each part
    books: list[np.ndarray]
    spread: np.ndarray  # of each list
    width: float = 0.0
    share: float = 1.0

    @property
    def lists(self) -> int:
        return len(self.first) * len(self.second)

    @property
    def coarse(self) -> np.ndarray:
        return (self.first[:, None, :] + self.second[None]).reshape(self.lists, self.dim)

    def assign(self, x: np.ndarray) -> np.ndarray:
        a = nearest(x, self.first)
        return a * len(self.second) + nearest(x - self.first[a], self.second)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.assign(x)
        rest = x - self.first[a // len(self.second)] - self.second[a % len(self.second)]
        return a, np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def known(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What list and code say of a vector."""
        out = self.first[lists // len(self.second)] + self.second[lists % len(self.second)]
        for part, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, cut] += book[codes[:, part]]
        return out

    def centre_scores(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with the centroids of all lists."""
        return ((q @ self.first.T)[:, :, None] + (q @ self.second.T)[:, None, :]).reshape(len(q), self.lists)

    def order(self, q: np.ndarray, width: float) -> np.ndarray:
        """The lists in the order in which each query visits them."""
        far = width * np.sqrt((q * q).sum(axis=1))
        return np.argsort(-(self.centre_scores(q) + far[:, None] * self.spread), axis=1, kind="stable")

    def visits(self, q: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Whether a query visits a list: the share of the lists, and more until they have `least` rows."""
        order = self.order(q, self.width)
        most = np.maximum((np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1, int(np.ceil(self.share * self.lists)))
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(self.lists) < most[:, None], axis=1)
        return out

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part the inner products of the queries with its codewords."""
        return [(q[:, c] @ b.T).astype(np.float32) for c, b in zip(self.cuts, self.books, strict=True)]


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, k: int = 20, target: float = 0.98, parts: int = 16) -> Quantiser | None:
    """Centroids, codebooks and share of lists from a bounded sample; None if no vector takes part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null")
    n = rows.count()
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    column = got.column("vector").combine_chunks() if got.num_rows else None
    if column is None or not len(column):
        return None
    lengths = column.value_lengths().to_numpy()
    dim = int(np.argmax(np.bincount(lengths[lengths > 0]))) if (lengths > 0).any() else 0
    x, _ = matrix(column, dim)
    if not len(x):
        return None
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    drawn, x = len(x), np.unique(x, axis=0)  # a vector that is there often must not stand for the others
    first, second = _centroids(x, max(1, round(n**0.5)))
    model = Quantiser(dim, kind, first, second, [c for c in np.array_split(np.arange(dim), min(parts, dim)) if len(c)], [], np.zeros(len(first) * len(second)))
    a = model.assign(x)
    rest = x - model.first[a // len(second)] - model.second[a % len(second)]
    model.books = [kmeans(rest[:, c], min(256, len(x)), 5, 2 + i) for i, c in enumerate(model.cuts)]
    # spread of a list's rows in one direction; lists with few rows in the sample lean on that of all
    far = (rest * rest).sum(axis=1) / dim
    many = np.bincount(a, minlength=model.lists)
    model.spread = np.sqrt((np.bincount(a, weights=far, minlength=model.lists) + 4 * far.mean()) / (many + 4))
    # a sample of one row in ten holds two of the 20 nearest of all rows
    stands = max(1, round(k * min(1.0, drawn / max(n, 1))))
    model.share, model.width = min((_share(x, a, model, w, stands, target), w) for w in WIDTHS)
    return model


def _centroids(x: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second centroids that give about so many lists."""
    most = max(1, len(x) // CENTROID_ROWS)
    first = kmeans(x, min(lists, most), 8, 1)
    more = min(most, -(-lists // len(first)))
    if more == 1:
        return first, np.zeros((1, x.shape[1]))
    return first, kmeans(x - first[nearest(x, first)], more, 8, 1)


def _share(x: np.ndarray, lists: np.ndarray, model: Quantiser, width: float, k: int, target: float, queries: int = 400) -> float:
    """Least share of the lists, in their order for the query, that hold `target` of the true neighbours in the sample."""
    q = np.arange(0, len(x), max(1, len(x) // queries))[:queries]
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    rank = np.empty((len(q), model.lists), np.int64)
    np.put_along_axis(rank, model.order(x[q], width), np.arange(model.lists)[None, :], axis=1)
    where = np.sort(np.take_along_axis(rank, lists[top], axis=1).reshape(-1))
    return float((where[int(np.ceil(target * len(where))) - 1] + 1) / model.lists)


def build(vectors: DataFrame, model: Quantiser, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every row that takes part: its list, code and vector; written to the shared folder."""
    cols = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null")

    def run(batches):
        for b in batches:
            x, rows = matrix(b.column(1), model.dim)
            a, codes = model.encode(x)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), b.column(0).take(pa.array(rows)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x.astype(model.kind)], pa.binary())], names=["list", "id", "code", "vector"])

    return staged(cols.mapInArrow(run, INDEX), "ann-index")


def _deal(centroids: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First bin of each list, in how many it is, and the number of bins. Lists are halved along the axis on which they
    differ most until a group has at most `limit` rows, so a bin's lists are neighbours; a longer list is in several."""
    first, many, bins = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0
    waiting = [np.arange(len(sizes))]
    while waiting:
        group = waiting.pop()
        load = int(sizes[group].sum())
        if load <= limit or len(group) == 1:
            first[group], many[group] = bins, max(1, -(-load // limit))
            bins += int(many[group[0]])
            continue
        weight = sizes[group].astype(float)
        c = centroids[group] - np.average(centroids[group], axis=0, weights=weight)
        order = np.argsort(c @ np.linalg.eigh(c.T @ (c * weight[:, None]))[1][:, -1], kind="stable")
        cut = min(max(int(np.searchsorted(np.cumsum(weight[order]), load / 2)), 1), len(group) - 1)
        waiting += [group[order[cut:]], group[order[:cut]]]
    return first, many, bins


def _vectors(column: pa.Array, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _spread(model: Quantiser, sizes: np.ndarray, first: np.ndarray, many: np.ndarray, slices: int, every: int, k: int) -> Callable:
    """Index rows to their bins (for each slice of queries), and queries to the bins of the lists they visit."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    # each list with each of its bins, in the order of the bins
    lists = np.repeat(np.arange(len(sizes)), many)
    bins = np.repeat(first, many) + np.arange(len(lists)) - np.repeat(np.cumsum(many) - many, many)
    lists, bins = lists[(by := np.argsort(bins, kind="stable"))], bins[by]

    def queries(b: pa.RecordBatch, at: np.ndarray):
        q = _vectors(b.column(3).take(pa.array(at)), model.kind, len(at)).astype(np.float64)
        who, pair = np.nonzero(model.visits(q, sizes, 4 * k)[:, lists])
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(bins[pair]) != 0)]))
        take = pa.array(at[who[starts]])
        turn = (mix64(b.column(1).to_numpy()[at[who[starts]]].view(np.uint64)) % np.uint64(slices)).astype(np.int64)
        m, probes = len(starts), list_array(pa.array(lists[pair].astype(np.int32)), np.diff(np.append(starts, len(pair))))
        return pa.RecordBatch.from_arrays([
            pa.array((bins[pair[starts]] * slices + turn).astype(np.int32)), pa.array(np.ones(m, np.int32)), b.column(1).take(take), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), b.column(3).take(take), probes,
        ], names=names)

    def run(batches):
        step = max(1, SCORES // max(len(lists), 1))
        for b in batches:
            n, ids, own = b.num_rows, b.column(1).to_numpy(), b.column(0).to_numpy()
            # another mix than that of the slices
            bin_ = first[own] + (mix64(ids.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) % many[own].astype(np.uint64)).astype(np.int64)
            for s in range(slices):
                yield pa.RecordBatch.from_arrays([pa.array((bin_ * slices + s).astype(np.int32)), pa.array(np.zeros(n, np.int32)), b.column(1), b.column(0), b.column(2), b.column(3), pa.nulls(n, pa.list_(pa.int32()))], names=names)
            at = np.flatnonzero(ids % every == 0)
            for i in range(0, len(at), step):
                yield queries(b, at[i : i + step])

    return run


class Bin:
    """The rows of one bin, in the order of their ids."""

    def __init__(self, model: Quantiser, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches)
        self.model, self.ids = model, t.column("id").to_numpy()
        lists = t.column("list").to_numpy()
        self.codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.vectors = _vectors(t.column("vector"), model.kind, len(self.ids))
        # usual size of a score's quantisation error, for a query of length 1
        self.error = np.concatenate([
            np.sqrt(((self.vectors[i : i + 8192] - model.known(lists[i : i + 8192], self.codes[i : i + 8192])) ** 2).sum(axis=1)) / np.sqrt(model.dim) for i in range(0, len(lists), 8192)
        ]).astype(np.float32)
        by = np.argsort(lists, kind="stable")
        cuts = np.flatnonzero(np.diff(lists[by])) + 1
        self.members = {int(lists[rows[0]]): rows for rows in np.split(by, cuts)}

    def search(self, ids: np.ndarray, q: np.ndarray, probes: pa.ListArray, k: int, rerank: int) -> list[tuple[int, int, float]]:
        tables = self.model.tables(q)
        near = np.full((len(ids), len(self.ids)), -np.inf, np.float32)
        asked, owner = probes.flatten().to_numpy(), np.repeat(np.arange(len(ids)), probes.value_lengths().to_numpy())
        by = np.argsort(asked, kind="stable")
        for who in np.split(by, np.flatnonzero(np.diff(asked[by])) + 1):
            if not len(who) or (rows := self.members.get(int(asked[who[0]]))) is None:
                continue
            (one, two), who = divmod(int(asked[who[0]]), len(self.model.second)), owner[who]
            score = np.repeat((q[who] @ (self.model.first[one] + self.model.second[two])).astype(np.float32)[:, None], len(rows), axis=1)
            for part, table in enumerate(tables):
                score += table[who][:, self.codes[rows, part]]
            near[np.ix_(who, rows)] = score
        out, length = [], np.sqrt((q * q).sum(axis=1)).astype(np.float32)
        for i, row in enumerate(near):
            row[self.ids == ids[i]] = -np.inf
            some = np.arange(len(row))
            if len(row) > k:
                # rows whose score may reach the kth best, and the best of the rest up to `rerank`
                bar = np.partition(row, len(row) - k)[len(row) - k]
                some = np.flatnonzero(row + MARGIN * length[i] * self.error >= bar)
                if len(some) < min(rerank, len(row)):
                    some = np.argsort(-row, kind="stable")[:rerank]
            some = some[row[some] > -np.inf]
            exact = (self.vectors[some].astype(np.float64) * q[i]).sum(axis=1)
            best = np.lexsort((self.ids[some], -exact))[:k]
            out += [(int(ids[i]), int(self.ids[some[b]]), float(exact[b])) for b in best]
        return out


def _scan(model: Quantiser, k: int, rerank: int) -> Callable:
    def answer(bin_: Bin, queries: pa.RecordBatch):
        step = min(256, max(1, SCORES // max(len(bin_.ids), 1)))
        for a in range(0, queries.num_rows, step):
            part = queries.slice(a, step)
            q = _vectors(part.column(5), model.kind, part.num_rows).astype(np.float64)
            got = bin_.search(part.column(2).to_numpy(), q, part.column(6), k, rerank)
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches):
        current, waiting, ready = None, [], None
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                piece, bin_, query = b.slice(x, y - x), int(key[x]) // 2, int(key[x]) % 2
                if bin_ != current:
                    current, waiting, ready = bin_, [], None
                if not query:
                    waiting.append(piece)
                else:
                    if ready is None and waiting:
                        ready, waiting = Bin(model, waiting), []
                    if ready is not None:
                        yield from answer(ready, piece)

    return run


def search(index: DataFrame, model: Quantiser, every: int = 20, k: int = 20, rerank: int = 60) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose id `every` divides."""
    counts = index.groupBy("list").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).toArrow()  # a row for each list, about the root of all rows
    sizes, asked = np.zeros(model.lists, np.int64), int(np.sum(counts.column("q").to_numpy()))
    sizes[counts.column("list").to_numpy()] = counts.column("n").to_numpy()
    most = max(1, BIN_BYTES // (model.dim * np.dtype(model.kind).itemsize))
    first, many, bins = _deal(model.coarse, sizes, max(1, min(most, -(-int(sizes.sum()) // LEAST_BINS))))
    slices = max(1, -(-asked // SLICE_QUERIES))
    rows = index.mapInArrow(_spread(model, sizes, first, many, slices, every, k), ROWS).repartition(bins * slices, "bin").sortWithinPartitions("bin", "query", "id")
    found = rows.mapInArrow(_scan(model, k, rerank), "query_id long, vec_id long, score double")
    # several rows with one query's id find a neighbour more than once: these rows share a rank
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"])
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = 0.98) -> DataFrame:
    """Fit, index and search of a table."""
    model = fit(vectors, id_col, vector_col, k=k, target=target)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(build(vectors, model, id_col, vector_col), model, every, k)
