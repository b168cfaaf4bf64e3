"""Word shingles of many texts at once: words are runs without white space, A-Z lower-cased, shingles are 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64
from .tokenizing import forget_encoders

_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
PLACE_KEYS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def hash_strings(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes (polynomial in an odd base over random byte keys, then mixed)."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_string())
    offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offs[0] : offs[-1]] if words.buffers()[2] is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    size = np.diff(offs)
    out = size.astype(np.uint64) * STEP
    full = size > 0
    if len(data):
        first = (offs[:-1] - offs[0])[full]
        place = np.arange(len(data), dtype=np.int64) - np.repeat(first, size[full])
        powers = np.ones(int(size.max()), np.uint64)
        powers[1:] = STEP
        np.multiply.accumulate(powers, out=powers)
        out[full] += np.add.reduceat(BYTE_KEYS[data] * powers[place], first)
    return mix64(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each text."""
    forget_encoders()
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offs = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offs = offs - offs[0]
    coded = flat.dictionary_encode()
    hashes = hash_strings(coded.dictionary)
    idx = coded.indices.to_numpy()
    empty = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    keep = ~empty[idx] if len(idx) else np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(keep)])
    return hashes[idx[keep]] if len(idx) else np.zeros(0, np.uint64), upto[offs[1:]] - upto[offs[:-1]]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text its distinct n-word shingles as sorted hashes; fewer words count as one shingle, no words as none."""
    words, counts = word_hashes(texts)
    roll = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        roll += words[j : j + len(roll)] * PLACE_KEYS[j]
    roll = mix64(roll)
    out, a = [], 0
    for m in counts.tolist():
        if m >= n:
            out.append(np.unique(roll[a : a + m - n + 1]))
        elif m:
            part = (words[a : a + m] * PLACE_KEYS[:m]).sum(dtype=np.uint64) + np.uint64(m)
            out.append(mix64(np.array([part], np.uint64) ^ STEP))
        else:
            out.append(np.zeros(0, np.uint64))
        a += m
    return out


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
