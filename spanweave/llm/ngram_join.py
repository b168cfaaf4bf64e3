"""Exact Jaccard self-join of word n-gram sets, and the groups that its links make.

Equal sets become one node. The join is a rare-first prefix join in two steps:

1. A fixed share of the hash range (one and a half times the prefix share) is counted over all nodes. The order of n-grams is: this
   range by document frequency, then the rest by hash. A node whose n-grams of frequency 1 already fill its prefix
   can link to nothing; most nodes end here.
2. The full sets of the nodes left are ordered by their document frequency among these nodes (an order of all
   n-grams that can be shared), cut to their prefixes, and joined on prefix n-grams. Length and positional filters
   and a suffix filter (n-grams in each sixteenth of the hash range) drop pairs before the exact check.

A group of copies is not expanded into all pairs: for each prefix n-gram the node with the fewest n-grams of its own
(the likely original) is checked against the others first. Then only nodes outside the group of most of an n-gram's
nodes are paired with those of other groups. Pairs inside a group are linked already, so no link between groups is
lost. Components are found by minimum labels with pointer jumping, each round written to the shared folder.

Defined results: null or wordless text has an empty set and no links; rows with a null doc_id take no part (null
component); rows with equal doc_ids and different sets are different nodes; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, drop_path, frugal, list_array, mix64, release_shuffles, slices, staged
from .shingles import STEP, set_digest, shingle_sets

#: Parts of the hash range that the suffix filter compares.
PARTS = 16


def prefix_size(n: int, percent: int) -> int:
    """n-grams of a set of n that any partner with 100 * intersection >= percent * union must share one of."""
    return n - -(-percent * n // 100) + 1


def low_end_of(percent: int) -> int:
    """End of the share of the hash range whose n-grams are counted over all nodes."""
    return min(2**64 - 1, 3 * (100 - percent) * 2**64 // 200)


def _sketches(n: int, percent: int) -> Callable:
    low_end = np.uint64(low_end_of(percent))

    @frugal
    def run(batches):
        for batch, texts in slices(batches, "text"):
            sets = shingle_sets(texts, n)
            low, kept = [], []
            for s in sets:
                k = int(np.searchsorted(s, low_end))
                low.append(k)
                kept.append(s[: max(k, prefix_size(len(s), percent))] if len(s) else s)
            values = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("text_hash")), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array(low, pa.int64()), list_array(pa.array(values), np.array([len(k) for k in kept], np.int64)),
            ], names=["doc_id", "text_hash", "n", "digest", "low", "grams"])

    return run


def _full_sets(n: int, bits: np.ndarray) -> Callable:
    """Sets of the documents whose id is in a Bloom filter."""

    @frugal
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy().view(np.uint64)
            maybe = batch.filter(pa.array(in_bloom(bits, ids)))
            for part, texts in slices(iter([maybe]), "text"):
                sets = shingle_sets(texts, n)
                keep = [i for i, s in enumerate(sets) if len(s)]
                values = np.concatenate([sets[i] for i in keep]).view(np.int64) if keep else np.zeros(0, np.int64)
                edges = [np.bincount((sets[i] >> np.uint64(60)).astype(np.int64), minlength=PARTS) for i in keep]
                yield pa.RecordBatch.from_arrays([
                    part.column(part.schema.get_field_index("doc_id")).take(pa.array(keep, pa.int64())), pa.array([set_digest(sets[i]) for i in keep], pa.binary()), pa.array([len(sets[i]) for i in keep], pa.int64()),
                    list_array(pa.array(values), np.array([len(sets[i]) for i in keep], np.int64)), list_array(pa.array(np.concatenate(edges).astype(np.int32) if edges else np.zeros(0, np.int32)), np.full(len(keep), PARTS)),
                ], names=["doc_id", "digest", "n", "grams", "parts"])

    return run


#: Most bits of the Bloom filter (4 MB): a full filter lets more documents through to the exact join, it loses none.
BLOOM_BITS = 1 << 25
BLOOM_HASHES = 5


def bloom(ids: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of a column of ids, of at most BLOOM_BITS bits, merged by Spark."""
    bits = min(BLOOM_BITS, max(1 << 10, 1 << (12 * count).bit_length()))
    key = F.col(ids.columns[0])

    def places(batches):
        for b in batches:
            at = bloom_places(b.column(0).to_numpy().view(np.uint64), bits).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "mask"])

    words = ids.select(key.alias("id")).mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([mix64(ids + np.uint64((k + 1) * int(STEP) % 2**64)) & np.uint64(bits - 1) for k in range(BLOOM_HASHES)])


def in_bloom(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = bloom_places(ids, len(words) * 64)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def _prefix(percent: int) -> str:
    return f"(n - cast(ceil({percent} * n / 100) as bigint) + 1)"


def _frequent(grams: DataFrame) -> DataFrame:
    """gram, node -> node, shared: for each node its (df, gram) of frequency 2 and more."""
    df = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 2")
    return grams.join(df, "gram").groupBy("node").agg(F.collect_list(F.struct("df", "gram")).alias("shared"))


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """links: a, b (each link once). Returns node, label: the smallest node that links reach from it."""
    both = ws.staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = ws.staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("m"))
        step = ws.staged(step, "labels")
        jump = step.join(step.select(F.col("node").alias("m"), F.col("m").alias("mm")), "m", "left").select("node", F.least("m", F.coalesce("mm", "m")).alias("label"), (F.least("m", F.coalesce("mm", "m")) != F.col("label")).alias("moved"))
        jump = ws.staged(jump, "labels")
        labels = jump.select("node", "label")
        if jump.where("moved").isEmpty():
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose sets are similar enough. Each set is read by its key; a frequent key's rows can be split by Spark."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    common = two.select("a", "b", F.size(F.array_intersect("ga", "gb")).cast("long").alias("i"), (F.size("ga") + F.size("gb")).cast("long").alias("both"))
    return common.where(f"100 * i >= {percent} * (both - i)").select("a", "b", "i", "both")


def _filters(percent: int) -> str:
    """Length, positional and suffix filter of pairs (x.n, x.pos, x.parts), (y. ...): what a common n-gram at these places leaves possible."""
    need = f"ceil({percent} * (x.n + y.n) / {100 + percent})"
    return f"""100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        and least(x.n - x.pos, y.n - y.pos) >= {need}
        and aggregate(zip_with(x.parts, y.parts, (p, q) -> least(p, q)), 0, (s, v) -> s + v) >= {need}"""


def similar_sets(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, labels): rows doc_id, text_hash, n, digest; nodes node, digest, doc_id (the smallest of its rows); labels node, label of the linked nodes."""
    with Workspace(docs.sparkSession, "jaccard") as ws:
        return _similar_sets(docs, n, percent, id_col, text_col, ws)


def _similar_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = cols.withColumn("text_hash", F.xxhash64("text"))
    wide, path = ws.kept(hashed.mapInArrow(_sketches(n, percent), "doc_id long, text_hash long, n long, digest binary, low long, grams array<long>"), "sketches")
    rows = staged(wide.select("doc_id", "text_hash", "n", "digest"), "rows")
    linked = wide.where("digest is not null and doc_id is not null")
    nodes, nodes_path = ws.kept(linked.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("grams").alias("grams")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    names = staged(nodes.select("node", "digest", "doc_id"), "names")
    drop_path(spark, path)
    release_shuffles(spark)

    # Step 1: nodes that still have a place for a shared n-gram in their prefix.
    shared = _frequent(nodes.select("node", F.explode("grams").alias("gram")))
    low_end = low_end_of(percent)
    inside = "true" if low_end >= 2**64 - 1 else f"(x.gram >= 0 and x.gram < {low_end})" if low_end < 2**63 else f"(x.gram >= 0 or x.gram < {low_end - 2**64})"
    left = nodes.select("node", "doc_id", "digest", "n", "low").join(shared, "node").where(f"low - size(filter(shared, x -> {inside})) < {_prefix(percent)}").select("node", "doc_id", "digest")
    left = ws.staged(left, "left")
    drop_path(spark, nodes_path)
    release_shuffles(spark)

    # Step 2: their full sets, from their texts.
    filter_ = bloom(left.select("doc_id"), left.count())
    found = cols.where("doc_id is not null").mapInArrow(_full_sets(n, filter_), "doc_id long, digest binary, n long, grams array<long>, parts array<int>").join(left, ["doc_id", "digest"])
    sets = ws.staged(found.groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams"), F.first("parts").alias("parts")), "sets")
    release_shuffles(spark)
    shared = _frequent(sets.select("node", F.explode("grams").alias("gram"))).select("node", F.array_sort("shared").alias("shared"))
    own = sets.select("node", "n", "parts").join(shared, "node").withColumn("own", F.col("n") - F.size("shared")).where(f"own < {_prefix(percent)}")
    prefix = own.select("node", "n", "own", "parts", F.posexplode(F.expr(f"slice(shared, 1, cast({_prefix(percent)} - own as int))")).alias("at", "s")).select("node", "n", "own", "parts", (F.col("own") + F.col("at")).alias("pos"), F.col("s.gram").alias("gram"))
    prefix = ws.staged(prefix, "prefix")
    release_shuffles(spark)

    # Pairs with the likely original of each n-gram.
    top = prefix.groupBy("gram").agg(F.count("*").alias("k"), F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "pos", "parts")).alias("y")).where("k >= 2").select("gram", "y")
    stars = prefix.alias("x").join(top, "gram").where(F.expr(f"x.node != y.node and {_filters(percent)}")).select(F.least("node", "y.node").alias("a"), F.greatest("node", "y.node").alias("b")).distinct()
    stars = ws.staged(stars, "stars")
    first = ws.staged(_verified(stars, sets, percent), "links")
    labels = components(first, ws)
    release_shuffles(spark)

    # Pairs across groups: one side is outside the group that has most nodes of the n-gram.
    marked = ws.staged(prefix.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "marked")
    sizes = marked.groupBy("gram", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("gram").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("groups")).where("groups >= 2").select("gram", F.col("m.label").alias("main"))
    open_ = marked.join(main, "gram")
    pairs = open_.where("label != main").alias("x").join(open_.alias("y"), F.expr(f"x.gram = y.gram and x.label != y.label and (y.label = y.main or x.node < y.node) and {_filters(percent)}"))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    second = ws.staged(_verified(pairs, sets, percent), "links")
    if not second.isEmpty():
        labels = components(first.unionByName(second), ws)
    release_shuffles(spark)
    return rows, names, staged(labels, "labels")


def _components(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, label (of the linked sets; null without a set) for each row."""
    rows, nodes, labels = similar_sets(docs, n, percent, id_col, text_col)
    tagged = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = tagged.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = tagged.join(least, "label").select("digest", "label", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(ids, "digest", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"), "label")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents link when 100 * intersection >= percent * union of their n-gram sets."""
    return _components(docs, n, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of linked texts, one with the group's smallest id, with all its columns.

    Of several texts under that id the one with the smallest hash stays, of equal rows one. Rows without an id stay
    all, and so does each text without words.
    """
    groups = _components(docs, n, percent, id_col, text_col)
    first = groups.where("doc_id = component_id").groupBy("doc_id", "label", F.when(F.col("label").isNull(), F.col("text_hash")).alias("bare")).agg(F.min("text_hash").alias("kept_hash"))
    kept = first.select(F.col("doc_id").alias("kept_id"), "kept_hash").distinct()
    text = F.col(f"`{text_col}`").cast("string")
    named = docs.select(F.col(id_col).cast("long").alias("kept_id"), F.xxhash64(text).alias("kept_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    w = Window.partitionBy("kept_id", "kept_hash").orderBy(F.lit(1))
    once = named.where("kept_id is not null").join(kept, ["kept_id", "kept_hash"]).withColumn("k", F.row_number().over(w)).where("k = 1").select("row")
    return once.unionByName(named.where("kept_id is null").select("row")).select("row.*")
