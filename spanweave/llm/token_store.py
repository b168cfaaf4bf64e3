"""Content-addressed token store.

Each text is encoded, an end id is appended, and a rolling hash over the ids cuts the stream into chunks whose
borders depend on the content alone. A chunk is stored once under its digest. Layout below one folder:

  objects/kind=chunk    key (16-byte digest), n (ids), payload (little-endian ids, 2 or 4 bytes each)
  objects/kind=recipe   one row for each document as it was encoded (unordered)
  recipes               part, doc_id, start, n_tokens, digests, counts, root; files (by name) and rows in ascending doc_id order
  manifest              a row for each part: its first id, documents, ids, and the Merkle root over its documents;
                        under part -1 the totals and the root over the parts

A document's root is that over its chunks' digests; a part's leaves are its documents' ids, places and roots. Reading
back checks each chunk against its digest and each recipe against its root, and fails on a missing chunk; `verify`
holds the files against the manifest.

Defined results: null text is empty (the end id alone); rows with a null doc_id come first; equal doc_ids keep one
recipe each, in a fixed order; texts of any length are encoded whole; an empty table gives a manifest of the totals
alone; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, list_array, mix64, path_exists, release_shuffles, scratch_path, slices
from .tokenizing import encoder, with_end

#: Ids in the window of the rolling hash; least, mean and most ids of a chunk.
WINDOW, LEAST, MEAN, MOST = 16, 256, 1024, 4096
#: Recipes of a part, and most parts: the manifest has a row for each, and so has the driver.
PART_ROWS, MOST_PARTS = 20_000, 20_000
OBJECTS = "kind string, key binary, n long, payload binary, doc_id long, digests array<binary>, counts array<int>"


def cut_points(ids: np.ndarray, counts: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[list[int]]:
    """For each document the ends of its chunks. A border depends on the WINDOW ids before it and on the last border."""
    roll = mix64(ids.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < WINDOW:
        more = roll.copy()
        more[step:] += roll[:-step] << np.uint64(step)
        roll, step = more, step * 2
    marks = np.flatnonzero((roll >> np.uint64(20)) % np.uint64(max(1, mean - least)) == 0) + 1
    ends, out = np.cumsum(counts), []
    lo = np.searchsorted(marks, ends - counts, "right")
    hi = np.searchsorted(marks, ends, "left")
    for a, n, i, j in zip((ends - counts).tolist(), counts.tolist(), lo.tolist(), hi.tolist(), strict=True):
        cuts, last = [], 0
        for m in itertools.chain((marks[i:j] - a).tolist(), [n]):
            while m - last > most:
                last += most
                cuts.append(last)
            if m - last >= max(least, WINDOW) or m == n:
                if m > last:
                    cuts.append(m)
                    last = m
        out.append(cuts)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and inner nodes are hashed apart. No leaves: the hash of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        odd = level[-1:] if len(level) % 2 else []
        level = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2], strict=False)] + odd
    return level[0]


def _encode(path: str, end: int, id_col: str, text_col: str, specials: bool = False) -> Callable:
    def run(batches):
        from pyspark import TaskContext

        part, serial, seen = TaskContext.get().partitionId(), 0, set()
        enc = encoder(path, specials=specials)
        for batch, texts in slices(batches, text_col):
            ids, counts, _ = enc.encode(texts)
            ids, counts = with_end(ids, counts, end)
            narrow = ids.astype(np.dtype("<u2") if enc.dtype.itemsize == 2 else np.dtype("<u4"))
            raw, w = memoryview(narrow).cast("B"), narrow.itemsize
            keys, ns, payloads, doc_digests, doc_counts = [], [], [], [], []
            base = 0
            for cuts in cut_points(ids, counts):
                digests, sizes, last = [], [], 0
                for c in cuts:
                    piece = raw[(base + last) * w : (base + c) * w]
                    d = hashlib.blake2b(piece, digest_size=16, salt=bytes([w])).digest()
                    digests.append(d)
                    sizes.append(c - last)
                    if d not in seen:
                        seen.add(d)
                        keys.append(d)
                        ns.append(c - last)
                        payloads.append(bytes(piece))
                    last = c
                base += last
                doc_digests.append(digests)
                doc_counts.append(sizes)
            if len(seen) > 500_000:  # only saves repeats within a task; the shuffle removes the rest
                seen = set()
            k, d = len(keys), len(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(["chunk"] * k + ["recipe"] * d), pa.array(keys + [b"%d:%d" % (part, serial + i) for i in range(d)], pa.binary()), pa.array(ns + counts.tolist(), pa.int64()),
                pa.array(payloads + [None] * d, pa.binary()), pa.concat_arrays([pa.nulls(k, pa.int64()), batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())]),
                pa.array([None] * k + doc_digests, pa.list_(pa.binary())), pa.array([None] * k + doc_counts, pa.list_(pa.int32())),
            ], names=["kind", "key", "n", "payload", "doc_id", "digests", "counts"])
            serial += d

    return run


class Tree:
    """The root of merkle() over leaves that come one after another; keeps one node of each level."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, node = 0, hashlib.blake2b(b"\0" + leaf, digest_size=16).digest()
        while self.nodes and self.nodes[-1][0] == level:
            level, node = level + 1, hashlib.blake2b(b"\1" + self.nodes.pop()[1] + node, digest_size=16).digest()
        self.nodes.append((level, node))

    def root(self) -> bytes:
        if not self.nodes:
            return merkle([])
        out = self.nodes[-1][1]
        for _, node in reversed(self.nodes[:-1]):
            out = hashlib.blake2b(b"\1" + node + out, digest_size=16).digest()
        return out


def write_store(docs: DataFrame, root: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", specials: bool = False) -> bytes:
    """Encodes docs and writes the store below root. Returns the manifest's top root."""
    spark = docs.sparkSession
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cols.mapInArrow(_encode(tokenizer, end, "doc_id", "text", specials), OBJECTS)
    once = rows.groupBy("kind", "key").agg(*(F.first(c).alias(c) for c in ("n", "payload", "doc_id", "digests", "counts")))
    once.write.partitionBy("kind").parquet(f"{root}/objects")
    release_shuffles(spark)
    recipes = spark.read.schema(OBJECTS.split(", ", 1)[1] + ", kind string").parquet(f"{root}/objects").where("kind = 'recipe'").select("key", "doc_id", "n", "digests", "counts")
    parts = min(MOST_PARTS, max(1, -(-recipes.count() // PART_ROWS)))
    ranged = recipes.repartitionByRange(parts, "doc_id", "key").withColumn("part", F.spark_partition_id())
    ranged.write.parquet(f"{root}/ordered")
    ordered = spark.read.schema("key binary, doc_id long, n long, digests array<binary>, counts array<int>, part int").parquet(f"{root}/ordered")
    # ids before each part: a number for each of at most MOST_PARTS parts
    sums = np.zeros(max(parts, spark.read.parquet(f"{root}/ordered").agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1), np.int64)
    for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect():
        sums[r.part] = r.n
    # a task holds whole parts and the tasks are in the order of parts, so are their files
    final = ordered.repartitionByRange(parts, "part").sortWithinPartitions("part", "doc_id", "key").select("part", "key", "doc_id", "n", "digests", "counts")
    final.mapInArrow(_recipes(np.cumsum(sums) - sums), RECIPES).write.parquet(f"{root}/recipes")
    drop_path(spark, f"{root}/ordered")
    rows = _part_roots(spark, root, parts)
    rows.append((-1, 0, sum(r[2] for r in rows), sum(r[3] for r in rows), merkle([r[4] for r in rows])))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{root}/manifest")
    return rows[-1][4]


RECIPES = "part int, key binary, doc_id long, start long, n_tokens long, digests array<binary>, counts array<int>, root binary"
MANIFEST = "part int, start long, docs long, ids long, root binary"


def _recipes(before: np.ndarray) -> Callable:
    """Adds each document's first id and root. Rows come in the order of parts and documents."""

    def run(batches):
        part, at = -1, 0
        for b in batches:
            own, n, starts = b.column(0).to_numpy(), b.column(3).to_numpy(), []
            for p, k in zip(own.tolist(), n.tolist(), strict=True):
                if p != part:
                    part, at = p, int(before[p])
                starts.append(at)
                at += k
            roots = [merkle(x or []) for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(starts, pa.int64()), b.column(3), b.column(4), b.column(5), pa.array(roots, pa.binary())], names=[c.split()[0] for c in RECIPES.split(", ")])

    return run


def _leaves(batches):
    """A manifest row for each part, from its rows in order; ids that do not follow each other without gaps leave the root empty."""
    part, tree, start, docs, at, whole = None, Tree(), 0, 0, 0, True

    def row():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (start, docs, at - start)), pa.array([tree.root() if whole else b""], pa.binary())], names=[c.split()[0] for c in MANIFEST.split(", ")])

    for b in batches:
        for p, begin, doc, n, root in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if p != part:
                if part is not None:
                    yield row()
                part, tree, start, docs, at, whole = p, Tree(), begin, 0, begin, True
            whole = whole and begin == at
            tree.add(f"{doc}:{begin}:{n}:".encode() + root)
            docs, at = docs + 1, begin + n
    if part is not None:
        yield row()


def _part_roots(spark: SparkSession, root: str, parts: int) -> list[tuple]:
    """The manifest's rows of the parts as the recipe files are now."""
    recipes = spark.read.schema(RECIPES).parquet(f"{root}/recipes").select("part", "start", "doc_id", "n_tokens", "root")
    found = recipes.repartitionByRange(parts, "part").sortWithinPartitions("part", "start").mapInArrow(_leaves, MANIFEST)
    return sorted(tuple(r) for r in found.collect())  # at most MOST_PARTS


def top_root(spark: SparkSession, root: str) -> bytes:
    """Root over the parts' roots."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where("part = -1").first().root


POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC's, bits reflected (bit 31 is the constant)."""
    a, b, out = a.copy(), b.copy(), np.zeros_like(b)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(POLY), np.uint32(0))
    return out


def crc_shift(crc: np.ndarray, zero_bytes: np.ndarray) -> np.ndarray:
    """What a finished crc32 adds to the crc32 of a longer string, if that many bytes follow."""
    out, left, k = crc.astype(np.uint32), zero_bytes.astype(np.uint64), 0
    power = np.full(1, 1 << 23, np.uint32)  # x to the power 8: one byte
    while (left >> np.uint64(k)).any():
        on = ((left >> np.uint64(k)) & np.uint64(1)).astype(bool)
        out[on] = _times(np.broadcast_to(power, on.sum()).copy(), out[on])
        power = _times(power, power)
        k += 1
    return out


def _check_chunks(batches):
    """Reads payloads back: number of ids (-1 where the digest is not the key) and crc32 of them as 32-bit integers."""
    for b in batches:
        keys, ns, payloads = (b.column(i).to_pylist() for i in range(3))
        crcs = []
        for i, (key, n, p) in enumerate(zip(keys, ns, payloads, strict=True)):
            w = len(p) // n
            if w not in (2, 4) or len(p) != n * w or hashlib.blake2b(p, digest_size=16, salt=bytes([w])).digest() != key:
                ns[i] = -1
                crcs.append(0)
            else:
                crcs.append(zlib.crc32(np.frombuffer(p, f"<u{w}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "stored", "crc"])


def _shift(batches):
    for b in batches:
        crc, tail = b.column(b.schema.get_field_index("crc")).to_numpy(), b.column(b.schema.get_field_index("tail")).to_numpy()
        got = crc_shift(crc.astype(np.uint32), tail * 4)
        i = b.schema.get_field_index("crc")
        yield b.set_column(i, "crc", pa.array(got.astype(np.int64)))


def _with_chunks(spark: SparkSession, root: str) -> DataFrame:
    """A row for each use of a chunk: its document, its place, and what the stored chunk holds (stored: null if it is missing, -1 if damaged)."""
    chunks = spark.read.schema("kind string, key binary, n long, payload binary").parquet(f"{root}/objects").where("kind = 'chunk'").select("key", "n", "payload").mapInArrow(_check_chunks, "digest binary, stored long, crc long")
    recipes = spark.read.schema(RECIPES).parquet(f"{root}/recipes")
    return recipes.mapInArrow(_uses, USES).join(chunks, "digest", "left")


def read_back(spark: SparkSession, root: str) -> DataFrame:
    """Documents as the files hold them: doc_id, start, n_tokens, ids_crc32. Fails on a chunk that is missing or damaged, and on a recipe without its root."""
    joined = _with_chunks(spark, root)
    good = F.col("sound") & F.coalesce(F.col("stored") == F.col("n"), F.lit(False))
    crc = F.when(good, F.col("crc")).otherwise(F.raise_error(F.concat(F.lit("the store cannot give back document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("long"))
    shifted = joined.withColumn("crc", crc).mapInArrow(_shift, joined.schema)
    return shifted.groupBy("key", "doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32")).drop("key")


USES = "key binary, doc_id long, start long, n_tokens long, sound boolean, digest binary, n long, tail long"


def _uses(batches):
    """A row for each chunk of each document: its ids, and how many ids of the document follow it. sound: the recipe has its root."""
    for b in batches:
        col = {n: b.column(b.schema.get_field_index(n)) for n in ("key", "doc_id", "start", "n_tokens", "digests", "counts", "root")}
        many = np.diff(col["counts"].offsets.to_numpy()).astype(np.int64)
        rows = pa.array(np.repeat(np.arange(len(many)), many))
        counts = col["counts"].flatten().to_numpy().astype(np.int64)
        sound = pa.array([merkle(d) == r for d, r in zip(col["digests"].to_pylist(), col["root"].to_pylist(), strict=True)], pa.bool_())
        ends = np.cumsum(col["n_tokens"].to_numpy())
        tail = np.repeat(ends, many) - np.cumsum(counts)
        yield pa.RecordBatch.from_arrays([*(col[n].take(rows) for n in ("key", "doc_id", "start", "n_tokens")), sound.take(rows), col["digests"].flatten(), pa.array(counts), pa.array(tail)], names=[c.split()[0] for c in USES.split(", ")])


def reconstruct(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, ids: the documents' ids again, with the end id (checked against the recipes)."""
    chunks = spark.read.schema("kind string, key binary, n long, payload binary").parquet(f"{root}/objects").where("kind = 'chunk'").select(F.col("key").alias("digest"), "payload")
    uses = spark.read.schema(RECIPES).parquet(f"{root}/recipes").mapInArrow(_uses, USES)
    together = uses.join(chunks, "digest").groupBy("key", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct((-F.col("tail")).alias("order"), "n", "payload"))).alias("pieces"))

    def run(batches):
        for b in batches:
            ids = []
            for ps in b.column(b.schema.get_field_index("pieces")).to_pylist():
                ids.append(np.concatenate([np.frombuffer(p["payload"], f"<u{len(p['payload']) // p['n']}").astype(np.int64) for p in ps]))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("start")), list_array(pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), np.array([len(x) for x in ids], np.int64))], names=["doc_id", "start", "ids"])

    return together.mapInArrow(run, "doc_id long, start long, ids array<long>")


def verify(spark: SparkSession, root: str, top: bytes | None = None) -> bool:
    """Whether the recipe files are those of the manifest (whose top root is `top`, if given) and every document can be rebuilt."""
    if not all(path_exists(spark, f"{root}/{x}") for x in ("manifest", "recipes", "objects")):
        return False
    held = sorted(tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest").collect())  # at most MOST_PARTS
    if not held or held[0][0] != -1 or top is not None and held[0][4] != top:
        return False
    parts, at = held[1:], 0
    for part in parts:
        if part[1] != at:
            return False
        at += part[3]
    if held[0] != (-1, 0, sum(r[2] for r in parts), at, merkle([r[4] for r in parts])) or _part_roots(spark, root, max(1, len(parts))) != parts:
        return False
    good = F.col("sound") & F.coalesce(F.col("stored") == F.col("n"), F.lit(False))
    return _with_chunks(spark, root).where(~good).isEmpty()


def store_digest(docs: DataFrame, tokenizer: str, end: int, root: str | None = None, specials: bool = False) -> DataFrame:
    """Writes docs to a store and returns what is read back from its files."""
    spark = docs.sparkSession
    root = root or scratch_path(spark, "token-store")
    write_store(docs, root, tokenizer, end, specials=specials)
    return read_back(spark, root)
