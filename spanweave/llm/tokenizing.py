"""Vectorised encoding with a file of the tokenizers library.

The two public byte-pair files cut a text into pre-tokens that never cross from a non-space to a space. So a text
may be cut before a space that follows a non-space, each different unit is encoded once by the library, and the
ids are gathered with numpy. Units are remembered in two generations of bounded size: forgetting costs time, never
rows. Files of any other kind, texts with spaces in other arrangements, and, with `specials`, texts that hold an added
token such as <|endoftext|>, go to the library whole. Without `specials` such a text is encoded as ordinary characters.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: In these characters Python's classes agree with those of the library.
SIMPLE = re.compile(rf"[ -~\n{LETTERS}]*\Z")
BYTE_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
#: Units that are one pre-token.
BYTE_ONE, WORD_ONE = re.compile(rf" ?[{LETTERS}]+\Z"), re.compile(rf"[{LETTERS}]+\Z")
UNIT = re.compile(r"\s*\S+|\s+\Z")
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> str:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b) if b in keep else chr(next(other)) for b in range(256))


class BatchEncoder:
    """encode(): ids of many texts at once. With starts, the first character of each token too."""

    def __init__(self, path: str, memo: int = 400_000, starts: bool = False, specials: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # the library reads added tokens in a text unless told otherwise
        self.tok.encode_special_tokens = not specials
        spec = json.loads(self.tok.to_str())
        self.kind = self._kind(spec)
        contents = [re.escape(t["content"]) for t in spec["added_tokens"] if t["content"]] if specials else []
        #: Texts with an added token, in any case as normalisers may change it.
        self.added = "|".join(contents)
        self.holds_added = re.compile(self.added, re.IGNORECASE) if contents else None
        self.starts, self.memo = starts, memo
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        alphabet = byte_alphabet()
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        assert sys.byteorder == "little" and array(self.code).itemsize == self.dtype.itemsize and array("I").itemsize == 4
        self.space, self.line = alphabet[32], alphabet[10]
        self.model = self.tok.model
        self.table = {i: alphabet[i] for i in range(256)}
        self.new: dict = {}
        self.old: dict = {}

    @staticmethod
    def _kind(spec: dict) -> str:
        if spec["model"]["type"] != "BPE" or spec["post_processor"] or spec["truncation"] or spec["padding"] or any(not t["special"] for t in spec["added_tokens"]):
            return "whole"
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return "byte"
        parts = [p["type"] for p in pre.get("pretokenizers", [])]
        steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
        if parts == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0]["invert"]:
            return "word"
        return "whole"

    def _pre(self, p: str) -> bytes:
        """One pre-token by the library's model."""
        if p.isascii():
            raw, mapped = p, p.replace(" ", self.space).replace("\n", self.line)
        else:
            raw = p.encode()
            mapped = raw.decode("latin-1").translate(self.table)
        found = self.model.tokenize(mapped)
        ids = array(self.code, [t.id for t in found]).tobytes()
        if not self.starts:
            return ids
        # starts: the first characters of the tokens as 4-byte integers
        at = array("I", accumulate((len(t.value) for t in found[:-1]), initial=0))[: len(found)]  # each character stands for a byte
        if len(raw) != len(p):
            lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
            return ids, lead[at].astype("<u4").tobytes()
        return ids, at.tobytes()

    def _fill(self, keys: list[str]) -> None:
        """Encodes units that are not remembered."""
        if len(self.new) > self.memo:
            self.old, self.new = self.new, {}
        new, old, hard, byte = self.new, self.old, [], self.kind == "byte"
        cut, one = (BYTE_CUT, BYTE_ONE) if byte else (WORD_CUT, WORD_ONE)

        def pre(p: str):
            # a pre-token is a unit of its own, so one memory serves both
            v = new.get(p)
            if v is None:
                v = old.get(p)
                if v is None:
                    v = self._pre(p)
                new[p] = v
            return v

        for k in keys:
            if one.match(k):
                new[k] = self._pre(k) if byte else pre(k.lower())
                continue
            if not SIMPLE.match(k):
                hard.append(k)
                continue
            parts = [(m.start(), pre(m[0])) for m in cut.finditer(k if byte else k.lower())]
            if self.starts:
                new[k] = b"".join(v[0] for _, v in parts), b"".join(v[1] if not a else array("I", [a + i for i in array("I", v[1])]).tobytes() for a, v in parts)
            else:
                new[k] = b"".join([v for _, v in parts])
        if hard:
            found = (self.tok.encode_batch if self.starts else self.tok.encode_batch_fast)(hard, add_special_tokens=False)
            for k, e in zip(hard, found, strict=True):
                ids = np.array(e.ids, dtype=self.dtype).tobytes()
                self.new[k] = (ids, np.array([o[0] for o in e.offsets], dtype="<u4").tobytes()) if self.starts else ids

    def _units(self, keys: list[str]) -> list:
        new, old = self.new, self.old
        out = list(map(new.get, keys))
        miss = [i for i, v in enumerate(out) if v is None]
        if miss:
            rest = []
            for i in miss:
                v = old.get(keys[i])
                if v is None:
                    rest.append(i)
                else:
                    out[i] = new[keys[i]] = v
            if rest:
                self._fill([keys[i] for i in rest])
                for i in rest:
                    out[i] = self.new[keys[i]]
        return out

    def _one(self, text: str):
        """One text: (ids, starts)."""
        if self.kind == "whole" or SEPARATORS.search(text) or self.holds_added and self.holds_added.search(text):
            e = self.tok.encode(text, add_special_tokens=False)
            return np.array(e.ids, dtype=self.dtype), np.array([o[0] for o in e.offsets], dtype=np.int64)
        units = UNIT.findall(text)
        got = self._units(units)
        if not self.starts:
            return np.frombuffer(b"".join(got), self.dtype), None
        base = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)
        n = [len(v[1]) // 4 for v in got]
        return np.frombuffer(b"".join(v[0] for v in got), self.dtype), np.frombuffer(b"".join(v[1] for v in got), "<u4").astype(np.int64) + np.repeat(base[:-1], n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """ids of all texts one after another, their number in each text, and first characters if asked for."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.kind == "whole":
            return self._joined([self._one(t) for t in texts.to_pylist()])
        parts = pc.split_pattern(texts, " ")
        values = parts.flatten()
        offs = parts.offsets.to_numpy().astype(np.int64)
        offs = offs - offs[0]
        coded = values.dictionary_encode()
        idx = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        first, last = offs[:-1], offs[1:] - 1
        if self.kind == "byte" or self.starts:
            used, where = np.unique(idx[first], return_inverse=True)
            idx[first] = len(words) + where
            keys = [f" {w}" for w in words] + [words[i] for i in used]
        else:
            keys = words
        bad = np.zeros(len(texts), bool)
        if self.holds_added:
            bad |= pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False)
        if self.kind == "byte":
            loose = np.fromiter((not k or k[-1].isspace() for k in keys), bool, len(keys))
            if loose.any():
                mark = loose[idx]
                mark[last] = False
                bad |= np.add.reduceat(mark.astype(np.int64), first) > 0
        got = self._units(keys)
        bits = self.dtype.itemsize
        if self.starts:
            vals = np.frombuffer(b"".join(v[0] for v in got), self.dtype)
            rel = np.frombuffer(b"".join(v[1] for v in got), "<u4")
            n = np.fromiter((len(v[0]) for v in got), np.int64, len(got)) // bits
        else:
            vals = np.frombuffer(b"".join(got), self.dtype)
            n = np.fromiter(map(len, got), np.int64, len(got)) // bits
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        lens = n[idx]
        upto = np.cumsum(lens)
        take = np.repeat(begin[idx] - (upto - lens), lens)
        take += np.arange(len(take))
        ids = vals[take]
        counts = np.add.reduceat(lens, first)
        at = None
        if self.starts:
            chars = np.fromiter(map(len, keys), np.int64, len(keys))[idx]
            place = np.cumsum(chars) - chars
            place -= np.repeat(place[first], np.diff(offs))
            at = rel[take].astype(np.int64) + np.repeat(place, lens)
        if bad.any():
            ends = np.cumsum(counts)
            pieces = [self._one(texts[i].as_py()) if bad[i] else (ids[ends[i] - counts[i] : ends[i]], at[ends[i] - counts[i] : ends[i]] if self.starts else None) for i in range(len(counts))]
            return self._joined(pieces)
        return ids, counts, at

    def _joined(self, pieces):
        ids = np.concatenate([p[0] for p in pieces])
        at = np.concatenate([p[1] for p in pieces]) if self.starts else None
        return ids, np.array([len(p[0]) for p in pieces], dtype=np.int64), at


_encoders: dict = {}


def encoder(path: str, starts: bool = False, specials: bool = False) -> BatchEncoder:
    """One encoder for each file and worker process."""
    key = path, starts, specials
    if key not in _encoders:
        _encoders[key] = BatchEncoder(path, starts=starts, specials=specials)
    return _encoders[key]


def forget_encoders() -> None:
    """Frees the encoders of a worker process that goes on to other work: workers live as long as their executor."""
    if _encoders:
        _encoders.clear()
        gc.collect()


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends an end id to each text's ids."""
    out = np.full(len(ids) + len(counts), end, dtype=np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1
