"""Token counts of sections, by character offsets of tokens in the whole document.

A document is encoded once, as a whole. Its sections are half-open character spans; those of a text tile it (each
ends behind its separator), those of given fields may leave gaps. Tokens and spans are both in order, so the
interval join is a binary search. Rule for a token that crosses a border: it belongs to the section in which its
first character lies ("first"), or in which most of its characters lie, the earlier one on a tie ("most"). Tokens
in a gap belong to no section and are counted as unassigned.

Defined results: null or empty text has one empty section without tokens; a null doc_id stays null; rows with equal
doc_ids are counted apart; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokenizing import encoder

COUNTS = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"


def sections_of(text: str, separator: str) -> np.ndarray:
    """First characters of the sections of a text, and behind them its length."""
    starts, at = [0], text.find(separator)
    while at >= 0:
        at += len(separator)
        if at < len(text):
            starts.append(at)
        at = text.find(separator, at)
    return np.array([*starts, len(text)], dtype=np.int64)


def assign(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a border. starts, ends: the tokens' characters; borders: of tiling sections."""
    inner = borders[1:-1]
    first = np.searchsorted(inner, starts, "right")
    last = np.searchsorted(inner, np.maximum(ends - 1, starts), "right")
    cross = last > first
    if rule == "first" or not cross.any():
        return first, cross
    out = first.copy()
    for i in np.flatnonzero(cross):  # few tokens
        spans = range(first[i], last[i] + 1)
        share = [min(ends[i], borders[s + 1]) - max(starts[i], borders[s]) for s in spans]
        out[i] = first[i] + int(np.argmax(share))
    return out, cross


def tally(at: np.ndarray, counts: np.ndarray, borders: list[np.ndarray], rule: str) -> dict[str, np.ndarray]:
    """Sections of many documents at once: section, characters, tokens, crossing tokens, and the document of each.

    at: the tokens' first characters; counts: tokens of each document; borders: of each document's sections. The
    documents lie one behind the other with a place between them, so that one search finds the section of each token.
    """
    many, length = np.array([len(b) - 1 for b in borders], np.int64), np.array([b[-1] for b in borders], np.int64)
    base, ends = np.cumsum(length + 1) - (length + 1), np.cumsum(counts)
    begin = at.astype(np.int64) + np.repeat(base, counts)
    # a token ends where the next one with another first character begins; parts of one character share it
    following = np.append(begin[1:], 0) if len(begin) else begin.copy()
    some = counts > 0
    following[ends[some] - 1] = (base + length)[some]
    following = np.maximum(following, begin + 1)
    doc = np.repeat(np.arange(len(borders)), many)
    first = np.concatenate([b[:-1] for b in borders]) if borders else np.zeros(0, np.int64)
    where, cross = assign(begin, following, np.append(first + base[doc], (length + 1).sum()), rule)
    return {
        "doc": doc, "section": np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many), "char_start": first, "char_end": np.concatenate([b[1:] for b in borders]) if borders else first,
        "n_tokens": np.bincount(where, minlength=len(doc)), "n_crossing": np.bincount(where[cross], minlength=len(doc)),
    }


def _rows(docs: pa.Array, counts: np.ndarray, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    doc, section = found.pop("doc"), found.pop("section")
    return pa.RecordBatch.from_arrays([docs.take(pa.array(doc)), pa.array(section.astype(np.int32)), *(pa.array(v.astype(np.int64)) for v in found.values()), pa.array(counts[doc].astype(np.int64))], names=["doc_id", "section", *found, "doc_tokens"])


def _count(path: str, separator: str, rule: str, specials: bool = False) -> Callable:
    def run(batches):
        enc = encoder(path, starts=True, specials=specials)
        for batch, texts in slices(batches, "text"):
            _, counts, at = enc.encode(texts)
            borders = [sections_of(t, separator) for t in texts.to_pylist()]
            yield _rows(batch.column(batch.schema.get_field_index("doc_id")), counts, tally(at, counts, borders, rule))

    return run


def section_tokens(docs: DataFrame, tokenizer: str, separator: str = "\n", rule: str = "first", id_col: str = "doc_id", text_col: str = "text", specials: bool = False) -> DataFrame:
    """A row for each section of each document: its characters, its tokens, and how many of these reach into a later section."""
    if rule not in ("first", "most"):
        raise ValueError("rule must be first or most")
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(_count(tokenizer, separator, rule, specials), COUNTS)


def field_tokens(rows: DataFrame, tokenizer: str, fields: list[str], joiner: str = "\n", rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """The same for records of several text fields: they are joined to one text, each field with the joiner behind it is a section.

    section is the field's place in `fields`. Null fields are empty.
    """
    names = [f"f{i}" for i in range(len(fields))]
    cols = rows.select(F.col(id_col).cast("long").alias("doc_id"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(n) for f, n in zip(fields, names, strict=True)))
    whole = cols.withColumn("text", F.concat_ws(joiner, *names)).withColumn("sizes", F.array(*(F.length(n) for n in names))).select("doc_id", "text", "sizes")

    def run(batches):
        enc = encoder(tokenizer, starts=True)
        for batch, texts in slices(batches, "text"):
            _, counts, at = enc.encode(texts)
            borders = [np.concatenate([[0], np.cumsum(np.array(size) + len(joiner))]) for size in batch.column(2).to_pylist()]
            for b, text in zip(borders, texts.to_pylist(), strict=True):
                b[-1] = len(text)
            yield _rows(batch.column(0), counts, tally(at, counts, borders, rule))

    return whole.mapInArrow(run, COUNTS)
