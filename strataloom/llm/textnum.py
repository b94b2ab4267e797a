"""Words and shingles of Arrow batches of texts as numpy arrays of 64-bit hashes.

Words are runs of ASCII letters, digits and bytes from 0x80 of the UTF-8 text, A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: Bytes of a string beyond which a digest of it is taken instead of a chain over its words of 8 bytes.
LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    is_word = (byte >= 0x80) | ((byte >= 48) & (byte < 58)) | ((byte >= 65) & (byte < 91)) | ((byte >= 97) & (byte < 123))
    return is_word, np.where((byte >= 65) & (byte < 91), byte + 32, byte).astype(np.uint8)


IS_WORD, LOWER = _tables()
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string raw[start:end], by a chain of mixed steps that no structure of texts undoes."""
    word, size = eights(raw), end - start
    out = mix(size.astype(np.uint64) * _ODD + _U(seed + 1))
    long = np.flatnonzero(size > LONG)
    for i, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist(), strict=True):
        out[i] = int.from_bytes(hashlib.blake2b(raw[a:b].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, rest = start[live], size[live]
    while len(live):
        part = word[at] & _MASK[np.minimum(rest, 8)]
        out[live] = mix((out[live] ^ part) * _ODD + _U(0x632BE59BD9B4E019))
        on = rest > 8
        live, at, rest = live[on], at[on] + 8, rest[on] - 8
    return out


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about most bytes; a longer text is a range of its own."""
    sizes = np.diff(offsets(texts))
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def as_text(column: pa.Array) -> pa.Array:
    """A column's texts without nulls."""
    return column.cast(pa.large_string()).fill_null("")


def data(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends in them."""
    at = offsets(texts)
    held = texts.buffers()[2]
    raw = np.frombuffer(held, dtype=np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and each text's range in them (one more entry than texts)."""
    raw, at = data(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = IS_WORD[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return hashed(LOWER[raw], start, end), np.searchsorted(start, at)


def shingles(word: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the text of each. A text of fewer words has one shingle of them all."""
    count = np.diff(bounds)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    at = np.arange(len(text)) - first[text] + bounds[:-1][text]
    out = np.zeros(len(text), dtype=np.uint64)
    last = bounds[1:][text]
    for i in range(k):
        there = at + i < last
        word_i = np.where(there, word[np.minimum(at + i, max(len(word) - 1, 0))] if len(word) else _U(0), _U(0))
        out = mix(out * _ODD + word_i + _U(i + 1))
    return out, text


def distinct_in_text(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in order of (text, value), their text and how often each occurs."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return v[at], t[at], np.diff(np.append(at, len(v)))
