"""Columnar text kernels shared by the operators of this subpackage.

Everything works on whole Arrow batches: a text column becomes one flat array
of word codes plus offsets, so that per-word Python work happens once for each
distinct word of a batch.
"""

from __future__ import annotations

import struct
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII white space: the separators of the word class [^\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"


class Alphabet(NamedTuple):
    """What bytes stand for: whether each belongs to a word, and what it is folded to there."""

    inside: np.ndarray
    folded: np.ndarray


def alphabet(lower: bool, separators: bytes = SPACES) -> Alphabet:
    """Every byte that is no separator belongs to a word, U+0000 too; A-Z are folded if asked."""
    inside, folded = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    inside[list(separators)] = False
    if lower:
        folded[65:91] += 32
    return Alphabet(inside, folded)


#: Words of non-space characters, as written and with A-Z folded.
PLAIN = alphabet(False)
FOLDED = alphabet(True)
#: Words of letters, digits and everything beyond ASCII, with A-Z folded.
ALNUM = alphabet(True, bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def word_bounds(off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of word bytes; none crosses a row's end."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[off] = True
    before = np.append(False, inside)
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1 if len(inside) else starts
    return starts, ends


class Words:
    """The words of a batch of texts.

    offsets: row i has words offsets[i]:offsets[i + 1]. codes: each word's index
    into vocab, a list of bytes.
    """

    def __init__(self, column, of: Alphabet = PLAIN):
        off, raw = text_bytes(column)
        inside = of.inside[raw]
        starts, ends, packed = self.cut(raw, inside, *word_bounds(off, inside), of)
        self.starts, self.ends = starts, ends
        self.offsets = np.searchsorted(starts, off)
        bounds = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=bounds[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocab: list[bytes] = coded.dictionary.to_pylist()

    @staticmethod
    def cut(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: Alphabet):
        """(starts, ends, the words' bytes one after the other); subclasses may part words and fold them otherwise."""
        return starts, ends, of.folded[raw[inside]]

    def __len__(self) -> int:
        return len(self.codes)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        h = xxhash.xxh3_64_intdigest
        return np.fromiter((h(w) for w in self.vocab), np.uint64, len(self.vocab))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: Words are hashed in pieces of texts of so many bytes; a longer word by itself.
HASH_BYTES = 1 << 20
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


@cache
def _powers() -> np.ndarray:
    p = np.full(HASH_BYTES + 1, _FACTOR)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(column, of: Alphabet = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of rows, a 64-bit hash of each word), without a table of the distinct ones.

    A word's bytes stand for random numbers and are the coefficients of a
    polynomial modulo 2^64; running sums give all words of a piece at once.
    """
    off, raw = text_bytes(column)
    starts, ends = word_bounds(off, of.inside[raw])
    rows = np.searchsorted(starts, off)
    table, powers = mix(np.arange(1, 257, dtype=np.uint64))[of.folded], _powers()
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + HASH_BYTES, "right"))
        if j == i:
            out[i] = xxhash.xxh3_64_intdigest(of.folded[raw[a : ends[i]]].tobytes())
            i += 1
            continue
        b = int(ends[j - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[raw[a:b]] * powers[: b - a], out=sums[1:])
        first = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[first]) * powers[HASH_BYTES - first]
        i = j
    del starts, ends
    return rows, mix(out)


def windows(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k values, and of the whole row where it has fewer.

    Returns (offsets of rows, hashes in order of position). A row without
    values has none.
    """
    n = np.diff(offsets)
    per_row = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per_row, out=out_off[1:])
    out = np.empty(out_off[-1], np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    full = np.flatnonzero(n >= k)
    if len(full):
        acc = np.zeros(len(values) - k + 1, np.uint64)
        for j in range(k):
            acc = acc * step + values[j : j + len(acc)]
        keep = np.repeat(offsets[:-1][full] - np.concatenate([[0], np.cumsum(per_row[full])[:-1]]), per_row[full]) + np.arange(per_row[full].sum())
        to = np.repeat(out_off[:-1][full] - np.concatenate([[0], np.cumsum(per_row[full])[:-1]]), per_row[full]) + np.arange(per_row[full].sum())
        out[to] = acc[keep]
    for size in range(1, k):
        rows = np.flatnonzero(n == size)
        if len(rows):
            acc = np.full(len(rows), size, np.uint64)
            for j in range(size):
                acc = acc * step + values[offsets[:-1][rows] + j]
            out[out_off[:-1][rows]] = acc
    return out_off, mix(out)


def distinct(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out, np.concatenate(parts) if parts else np.zeros(0, np.uint64)


_KINDS = [np.uint8, np.uint16, np.uint32, np.uint64, np.int8, np.int16, np.int32, np.int64, np.float32, np.float64]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob, each integer array in the narrowest type that holds it."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        if a.dtype.kind in "ui" and len(a):
            low, high = a.min(), a.max()
            for k in _KINDS[:4] if low >= 0 else _KINDS[4:8]:
                if np.iinfo(k).min <= low and high <= np.iinfo(k).max:
                    a = a.astype(k)
                    break
        elif not len(a):
            a = a.astype(np.uint8)
        out += [struct.pack("<BQ", _KINDS.index(a.dtype.type), len(a)), a.tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    count, at, out = blob[0], 1, []
    for _ in range(count):
        kind, n = struct.unpack_from("<BQ", blob, at)
        at += 9
        out.append(np.frombuffer(blob, _KINDS[kind], n, at))
        at += n * np.dtype(_KINDS[kind]).itemsize
    return out


def pack_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column with runs of equal ids, as differences and run lengths."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    heads = ids[first]
    return np.append(heads[:1], np.diff(heads)), np.diff(np.append(first, len(ids)))


def unpack_runs(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    return np.repeat(np.cumsum(steps.astype(np.int64)), runs.astype(np.int64))
