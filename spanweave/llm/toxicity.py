"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit (on a bounded sample of labelled rows, see `examples`): every example is a TF-IDF vector of all its words, with
document frequencies over all documents. Examples of one label with the same words and counts are one with their number
as weight, so no example is lost. Words that toxic examples hold significantly more often (log-likelihood ratio above
twice the logarithm of the number of words tested, near copies within a label counted once) weigh more, by a factor.

Score: the nearest `neighbours` examples by cosine vote with s / (1.001 - s) as weight, s the similarity, so that a
copy of an example (similarity 1) outweighs what is merely alike. Words that no example holds count in a text's length
with the mean square of their idf. The votes are shrunk towards the toxic share of the labels; the strength of that and
the factor are chosen by leave-one-out log loss over at most `TRIALS` examples, so scores are probabilities. The
neighbours are the evidence. Similarities are rounded to six places, so a score does not depend on how rows are batched.

Defined results: null or wordless text, and text with no word of an example, gets the base rate and no evidence;
labels that are null or belong to no document are not used, of several labels for a document the highest counts;
without labels of both kinds the score is the smoothed share of toxic labels (a quarter without any); ties between examples go to the
smaller place among the examples (by doc_id); rows with equal ids are scored apart; a null doc_id stays null; texts of
any length are read whole; an empty table gives no rows; further columns are ignored, or kept by remove_toxic.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, frugal, list_array, release_shuffles, slices, trim_memory
from .shingles import shingle_sets
from .tokenizing import forget_encoders

#: What stands between words (which are lower-cased).
SEPARATOR = r"[^\p{L}\p{N}]+"
#: Most labelled rows of each class that the fit takes, least by a hash of the id.
EXAMPLES = 4000
#: A word of the vocabulary stands in this many toxic examples at least.
LEAST_TEXTS = 3
#: Examples of a block, and the words whose lists are read by blocks.
BLOCK, COMMON = 64, 512
#: Texts that the index searches at once.
QUERIES = 64
#: Examples left out in turn to choose factor and shrinkage.
TRIALS = 800
FACTORS, SHRINKS = (1.0, 2.0, 4.0, 8.0, 16.0), (0.05, 0.2, 0.5, 1.0, 2.0)
#: Different words that a task counts before it hands them on.
WORDS_HELD = 200_000
#: Bytes of text that are cut into words at once.
TEXT_BYTES = 2 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of all texts; for each text and word of it (in the order of texts) the text, the word, and how often it stands there."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), SEPARATOR)
    coded = parts.flatten().dictionary_encode()
    names, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, bool)
    key, number = np.unique(row[full] * len(names) + at[full], return_counts=True)
    row, word = np.divmod(key, max(1, len(names)))
    return names, row, word, number


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all ranges one after another, and the length of each range."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n), n


class BlockMaxIndex:
    """Exact nearest examples of sparse unit vectors.

    The lists of rare words are read whole. Those of the most common words lie in blocks of examples; a block's largest
    weight of each of these words bounds what they add to its examples. The blocks with the best bounds are read first,
    then those whose bound reaches the kth best found.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, count: int, terms: int, block: int = BLOCK, common: int = COMMON):
        """row, term, weight: the entries of the examples' vectors in the order of rows; count: of examples."""
        self.count, self.block = count, block
        often = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:common]
        self.slot = np.full(terms, -1, np.int32)
        self.slot[often] = np.arange(len(often))
        slot = self.slot[term]
        dense = np.flatnonzero(slot >= 0)
        # examples of one language and length side by side make tight bounds
        lead = np.full(count, -1)
        heavy = dense[np.argsort(weight[dense], kind="stable")]
        lead[row[heavy]] = slot[heavy]  # the last one written is the heaviest
        self.order = np.lexsort((np.bincount(row, minlength=count), lead)).astype(np.int32)
        self.place = np.empty(count, np.int32)
        self.place[self.order] = np.arange(count)
        self.dense = np.zeros((count, len(often)), np.float32)
        self.dense[self.place[row[dense]], slot[dense]] = weight[dense]
        self.first = np.arange(0, count, block)
        self.most = np.maximum.reduceat(self.dense, self.first, axis=0) if count else self.dense
        rare = np.flatnonzero(slot < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.start = np.searchsorted(term[rare], np.arange(terms + 1)).astype(np.int32)
        self.at, self.weight = self.place[row[rare]], weight[rare].astype(np.float32)

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and examples (n x k) of the k nearest, nearest first; a similarity of 0 stands for no example.

        row, term, weight: entries of the n query vectors in the order of rows. skip: an example that each query leaves out.
        """
        parts = [(np.zeros((0, k)), np.zeros((0, k), np.int64))]
        for a in range(0, n, QUERIES):
            i, j = np.searchsorted(row, [a, a + QUERIES])
            parts.append(self._batch(row[i:j] - a, term[i:j], weight[i:j], min(QUERIES, n - a), k, None if skip is None else skip[a : a + QUERIES]))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _batch(self, row, term, weight, n: int, wanted: int, skip) -> tuple[np.ndarray, np.ndarray]:
        k, slot = wanted, self.slot[term]
        rare = slot < 0
        query = np.zeros((n, self.dense.shape[1]), np.float32)
        query[row[~rare], slot[~rare]] = weight[~rare]
        postings, many = ranges(self.start[term[rare]].astype(np.int64), self.start[term[rare] + 1].astype(np.int64))
        weights = np.repeat(weight[rare].astype(np.float32), many)
        weights *= self.weight[postings]
        score = np.bincount(np.repeat(row[rare] * self.count, many) + self.at[postings], weights, n * self.count).astype(np.float32).reshape(n, self.count)
        del postings, weights
        if skip is not None:
            score[np.arange(n), self.place[skip]] = -1e9
        bound = np.maximum.reduceat(score, self.first, axis=1) + query @ self.most.T
        done = np.zeros(bound.shape, bool)
        todo = done.copy()
        np.put_along_axis(todo, np.argsort(-bound, axis=1, kind="stable")[:, : 1 + -(-k // self.block)], True, axis=1)
        for _ in range(2):
            for b in np.flatnonzero(todo.any(axis=0)):
                who, a = np.flatnonzero(todo[:, b]), b * self.block
                score[who, a : a + self.block] += query[who] @ self.dense[a : a + self.block].T
            done |= todo
            held = np.where(np.repeat(done, self.block, axis=1)[:, : self.count], score, -1e9)
            least = np.partition(held, max(0, self.count - k), axis=1)[:, max(0, self.count - k)]
            # rounding never hides a block
            todo = ~done & (bound + 1e-5 >= least[:, None]) & (bound > 0)
        # by similarity to six places, then by example
        held = np.where(held > 0, np.rint(held * 1e6), 0).astype(np.int64) * (self.count + 1) + (self.count - self.order)
        k = min(k, self.count)
        held.partition(self.count - k, axis=1)
        best = -np.sort(-held[:, self.count - k :], axis=1)
        out = np.zeros((n, wanted)), np.zeros((n, wanted), np.int64)
        near, example = np.divmod(best, self.count + 1)
        out[0][:, :k], out[1][:, :k] = np.minimum(near / 1e6, 1.0), self.count - example
        return out


@dataclass
class Model:
    vocabulary: list[str]  # words that mark toxicity
    words: pa.Array  # all words of the examples
    idf: np.ndarray
    unknown: float  # mean square of the idf of other words
    labels: np.ndarray
    copies: np.ndarray
    ids: np.ndarray
    index: BlockMaxIndex | None
    weights: tuple[float, float]
    base: float
    shrink: float
    neighbours: int

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (text, term, weight) of the known words, as of unit vectors over all words of each text."""
        names, row, word, number = words_of(texts)
        term = pc.fill_null(pc.index_in(names, value_set=self.words), -1).to_numpy(zero_copy_only=False)[word]
        weight, known = 1 + np.log(number), term >= 0
        rest = np.bincount(row[~known], self.unknown * np.square(weight[~known]), len(texts))
        row, term = row[known], term[known]
        weight = weight[known] * self.idf[term]
        length = np.sqrt(np.maximum(1e-12, np.bincount(row, np.square(weight), len(texts)) + rest))
        return row, term, weight / length[row]

    def vote(self, near: np.ndarray, examples: np.ndarray, shrink: float | None = None) -> np.ndarray:
        """The scores of texts with these similarities and examples (a row for each text)."""
        m, label = self.shrink if shrink is None else shrink, self.labels[examples]
        weight = near / (1.001 - near) * np.asarray(self.weights)[label] * self.copies[examples]
        return ((weight * label).sum(axis=1) + m * self.base) / (weight.sum(axis=1) + m)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and similarities and examples of the neighbours."""
        if self.index is None:
            none = np.zeros((len(texts), self.neighbours))
            return np.full(len(texts), self.base), none, none.astype(np.int64)
        near, examples = self.index.nearest(*self.vectors(texts), len(texts), self.neighbours)
        return self.vote(near, examples), near, examples


def _words(batches):
    """For examples: their distinct words, the number of each, and the four least of their shingles."""
    for batch, texts in slices(batches, "text"):
        low = [s[:4].view(np.int64).tolist() for s in shingle_sets(texts, 5)]
        names, row, word, number = words_of(texts)
        many = np.bincount(row, minlength=len(texts))
        # words in alphabetical order: equal examples have equal lists
        rank = np.argsort(pc.sort_indices(names).to_numpy())
        order = np.lexsort((rank[word], row))
        word, number = word[order], number[order]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(names.take(pa.array(word)), many), list_array(pa.array(number.astype(np.int32)), many), pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "toxic", "words", "counts", "low"])


@frugal
def _frequencies(batches):
    """Words and the number of rows of a task that hold them; a word may come more than once."""
    forget_encoders()
    held = None

    def merged(t: pa.Table) -> pa.Table:
        return t.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).select(["word", "n"])

    for _, texts in slices(batches, "text", TEXT_BYTES):
        names, _, word, _ = words_of(texts)
        n = np.bincount(word, minlength=len(names))
        t = pa.table({"word": names, "n": n.astype(np.int64)}).filter(pa.array(n > 0))
        held = t if held is None else merged(pa.concat_tables([held, t]))
        if held.num_rows > WORDS_HELD:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()


def distinct_examples(labels: list, low: list) -> np.ndarray:
    """Which examples share none of their least shingles with an example of their label before."""
    seen: dict[int, set] = {0: set(), 1: set()}
    out = np.zeros(len(labels), bool)
    for i, (y, s) in enumerate(zip(labels, low, strict=True)):
        out[i] = not seen[y].intersection(s)
        seen[y].update(s)
    return out


def choose_words(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Words that toxic examples hold significantly more often. toxic, other: for each word the examples that hold it."""
    tested = np.flatnonzero(toxic >= LEAST_TEXTS)
    a, b = toxic[tested].astype(float), other[tested].astype(float)
    if not n0 or not len(tested):
        return tested[:0]
    e1, e0 = (a + b) * n1 / (n0 + n1), (a + b) * n0 / (n0 + n1)
    ratio = 2 * (a * np.log(a / e1) + b * np.log(np.where(b > 0, b, 1) / np.where(b > 0, e0, 1)))
    return tested[(a * n0 > b * n1) & (ratio >= max(10.0, 2 * math.log(len(tested))))]


def learn_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", folds: int = 5) -> DataFrame:
    """Labels that may be learned from: those whose id's crc32 (as text) is no multiple of `folds`."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    return rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = 15, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """labels: doc_id, toxic (learn_rows). At most `examples` rows of each class are read on the driver."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    share = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        picked = part if picked is None else picked.unionByName(part)
    base, no = (share.get(1, 0) + 0.5) / (sum(share.values()) + 2), np.zeros(0, np.int64)
    model = Model([], pa.array([], pa.string()), np.zeros(0), 1.0, no, no, no, None, (1.0, 1.0), base, 1.0, neighbours)
    with Workspace(docs.sparkSession, "toxicity") as ws:
        # at most 2 * examples rows, whatever the size of labels; of several texts under an id one is taken
        found = cols.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_words, "doc_id long, toxic int, words array<string>, counts array<int>, low array<long>")
        found = found.groupBy("doc_id", "toxic").agg(F.min(F.struct("low", "words", "counts")).alias("x")).select("doc_id", "toxic", "x.low", "x.words", "x.counts")
        found = ws.staged(found.withColumn("same", F.sha2(F.to_json(F.struct("toxic", "words", "counts")), 256)), "examples")
        if found.select("toxic").distinct().count() == 2:
            _learn(model, share, cols, found, ws)
    release_shuffles(docs.sparkSession)
    trim_memory()
    return model


def _document_frequencies(model: Model, cols: DataFrame, found: DataFrame, ws: Workspace) -> None:
    """The idf of the examples' words (which come to the driver), and the mean square of that of the others."""
    n = cols.count()
    df = cols.select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    own = found.select(F.explode("words").alias("word")).distinct().withColumn("own", F.lit(1))
    df = ws.staged(df.join(own, "word", "left").select("word", (F.log((F.lit(n) + 1) / (F.col("n") + 1)) + 1).alias("idf"), "n", "own"), "words")
    other = df.where("own is null").agg(F.sum(F.col("n") * F.col("idf") * F.col("idf")) / F.sum("n")).first()[0]
    model.unknown = float(other) if other else (math.log(n + 1) + 1) ** 2
    known = df.where("own = 1").select("word", "idf").toArrow()
    order = pc.sort_indices(known["word"])
    model.words, model.idf = known["word"].take(order).combine_chunks(), known["idf"].take(order).to_numpy()


def _vectors(model: Model, found: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries (example, term, number) of the examples in the order of their ids, and which of them share no shingle with one before."""
    rows = found.orderBy("doc_id").select("doc_id", "toxic", "low", "same", "words", "counts").toArrow()
    label, words = rows.column("toxic").to_numpy(), rows.column("words").combine_chunks()
    alone = distinct_examples(label.tolist(), rows.column("low").to_pylist())
    many = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    term = pc.index_in(words.flatten(), value_set=model.words).to_numpy(zero_copy_only=False).astype(np.int32)
    number = rows.column("counts").combine_chunks().flatten().to_numpy().astype(np.int32)
    # equal examples of a label are one, with their number as weight
    groups: dict[str, list[int]] = {}
    for i, same in enumerate(rows.column("same").to_pylist()):
        groups.setdefault(same, []).append(i)
    kept = np.array([g[0] for g in groups.values()])
    model.weights = tuple(model.weights[y] / int((label == y).sum()) for y in (0, 1))
    model.ids, model.labels, model.copies = rows.column("doc_id").to_numpy()[kept].copy(), label[kept].astype(np.int64), np.array([len(g) for g in groups.values()])
    ends = np.cumsum(many, dtype=np.int64)
    take, size = ranges((ends - many)[kept], ends[kept])
    row, term, number = np.repeat(np.arange(len(kept), dtype=np.int32), size), term[take], number[take]
    return row, term, number, alone[kept]


def _learn(model: Model, share: dict, cols: DataFrame, found: DataFrame, ws: Workspace) -> None:
    """Document frequencies over all documents, the examples' vectors, the factor of the marking words, and shrinkage."""
    _document_frequencies(model, cols, found, ws)
    model.weights = share[0], share[1]
    row, term, number, alone = _vectors(model, found)
    trim_memory()
    terms, count, plain = len(model.words), len(model.ids), model.idf
    size = np.bincount(row, minlength=count)
    held = [np.bincount(term[(alone & (model.labels == y))[row]], minlength=terms) for y in (0, 1)]
    marks = choose_words(held[1], held[0], int((alone & (model.labels == 1)).sum()), int((alone & (model.labels == 0)).sum()))
    model.vocabulary = sorted(model.words.take(pa.array(marks)).to_pylist())
    # some of each label, dealt evenly
    trial = np.concatenate([own[:: max(1, -(-2 * len(own) // TRIALS))] for y in (0, 1) for own in [np.flatnonzero(model.labels == y)]])
    weight = np.zeros(count)
    for y, part in enumerate(model.weights):
        mine = model.labels == y
        weight[mine] = part * model.copies[mine] * model.copies[mine].sum() / max(1, model.copies[trial][model.labels[trial] == y].sum())
    entries, sizes = ranges((np.cumsum(size) - size)[trial], np.cumsum(size)[trial])
    asked, best = np.repeat(np.arange(len(trial)), sizes), None
    number = (1 + np.log(number)).astype(np.float32)
    for factor in FACTORS if len(marks) else FACTORS[:1]:
        model.idf = plain.copy()
        model.idf[marks] *= factor
        value = number * model.idf.astype(np.float32)[term]
        value /= np.sqrt(np.maximum(1e-12, np.bincount(row, np.square(value), count))).astype(np.float32)[row]
        model.index = None
        model.index = BlockMaxIndex(row, term, value, count, terms)
        near = model.index.nearest(asked, term[entries], value[entries], len(trial), model.neighbours, skip=trial)
        for m in SHRINKS:
            p = np.clip(model.vote(*near, m), 1e-9, 1 - 1e-9)
            loss = -(weight[trial] * np.log(np.where(model.labels[trial] == 1, p, 1 - p))).sum()
            if best is None or loss < best[0]:
                best = (loss, m, model.idf, model.index)
        trim_memory()
    _, model.shrink, model.idf, model.index = best


SCORES = "doc_id long, score double, evidence array<struct<doc_id: bigint, similarity: double, toxic: int>>"


def _score(model: Model, evidence: int) -> Callable:
    @frugal
    def run(batches):
        forget_encoders()
        for batch, texts in slices(batches, "text", TEXT_BYTES):
            scores, near, examples = model.score(texts)
            near, examples = near[:, :evidence], examples[:, :evidence]
            there = near > 0
            pick = examples[there]
            why = pa.StructArray.from_arrays([pa.array(model.ids[pick], pa.int64()), pa.array(near[there], pa.float64()), pa.array(model.labels[pick], pa.int32())], names=["doc_id", "similarity", "toxic"])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(scores, pa.float64()), list_array(why, there.sum(axis=1))], names=["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, model: Model, evidence: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of toxic) and the nearest examples for each row."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(_score(model, evidence), SCORES)


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    plain = next((f.name for f in docs.schema if f.name.lower() == text_col.lower() and f.dataType.simpleString() == "string"), None)
    probe = plain or fresh(docs.columns, "probe_text")

    @frugal
    def run(batches):
        forget_encoders()
        for batch, texts in slices(batches, probe, TEXT_BYTES):
            out = batch.filter(pa.array(model.score(texts)[0] < threshold))
            yield out if plain else out.drop_columns([probe])

    return (docs if plain else docs.withColumn(probe, F.col(text_col).cast("string"))).mapInArrow(run, docs.schema)
