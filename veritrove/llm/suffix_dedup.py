"""Removal of repeated passages by suffix arrays.

Every byte covered by a string of `length` bytes that also starts anywhere
else, in the same document or another, is removed; strings are judged on the
input. Texts are UTF-8 bytes.

1. Anchors. Of every `window` consecutive places one, chosen by the bytes there
   alone (the least hash of 16 bytes), is an anchor. A string of `length` bytes
   holds an anchor among its first `window` places, and two equal strings hold
   the same one. So they agree on the `length - window + 1` bytes from it: only
   anchors whose next bytes occur twice can lie in a repeat.
2. Marks. What travels is a fingerprint of those bytes, one of the anchor's
   whole context (long enough for any string that has it as its first anchor),
   and its place. A context that occurs twice is repeated whole, and where all
   contexts of a fingerprint are equal nothing else is asked for.
3. Order. Of other fingerprints one copy of each different context is fetched.
   Those of a bucket are cut into blocks from the anchor on, and a suffix array
   by linear grouping orders them; neighbours give the longest agreement to the
   right. Going left from the anchor byte by byte, contexts that agree so far
   stay together, and the neighbours among them say whether the string that
   starts there occurs twice. (Any sort of the contexts would give this result.)
4. The repeated places of each document are merged and cut out.

Hot fingerprints, found by counts of all slices before, are dealt by their
contexts, and a context that is hot itself is known to be repeated: only one
copy for each slice travels. Where a fingerprint is hot or has more than
GROUP_MOST different contexts, these aren't gathered in a task: what 16
neighbouring strings have in common is hashed and counted by Spark, and where
that occurs twice, the strings themselves.

Defined cases: null and empty texts, and texts shorter than `length`, lose
nothing; repeated rows and equal texts of `length` bytes or more lose all;
rows without an id lose nothing and nothing is lost for them; ids must name a
text; other columns pass through `row` untouched.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, sliced, stored, volume
from .suffix_array import suffix_array
from .words import mix, pack, pack_runs, text_bytes, unpack, unpack_runs

LENGTH = 400
WINDOW = 256
GRAM = 16
BLOCK = 16
SLICE = 2 << 20
BUCKET_BYTES = 32 << 20
BUCKET_DOCS = 4096
#: Different contexts of one fingerprint that a task may gather: some 10 MB.
GROUP_MOST = 20_000
#: Places of a fingerprint, or of a context, from which on it is hot: half of a bucket's.
HOT = 100_000


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place."""
    h, p = raw.astype(np.uint64) + np.uint64(1), 0x100000001B3
    for step in (1, 2, 4, 8):
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * np.uint64(p) + h[step:]
        p = p * p % (1 << 64)
    return mix(h)


def anchors(offsets: np.ndarray, raw: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places that hold the least hash of some `window` consecutive places; the leftmost of equal ones.

    Windows may reach over the end of a text; that adds anchors but loses none.
    """
    h = gram_hashes(raw)
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64)
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    whole = -(-n // window) * window
    padded = np.full(whole, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    found = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.unique(found[np.append(True, found[1:] != found[:-1])])


def placed_anchors(offsets: np.ndarray, raw: np.ndarray, length: int, window: int):
    """(row, place in the row, fingerprint, context's fingerprint) of anchors with enough bytes after them, in texts that are long enough."""
    at = anchors(offsets, raw, window)
    row = np.searchsorted(offsets, at, "right") - 1
    reach = length - window + 1
    good = (at + reach <= offsets[row + 1]) & (offsets[row + 1] - offsets[row] >= length)
    at, row = at[good], row[good]
    place = at - offsets[row]
    left, end = np.minimum(place, window - 1), np.minimum(at + length, offsets[row + 1])
    data, digest = raw.tobytes(), xxhash.xxh3_64_intdigest
    prints = np.fromiter((digest(data[a : a + reach]) for a in at.tolist()), np.uint64, len(at))
    marks = np.fromiter((digest(data[a - k : b], k + 1) for a, k, b in zip(at.tolist(), left.tolist(), end.tolist(), strict=True)), np.uint64, len(at))
    return row, place, prints, marks


def _runs(key: np.ndarray):
    if len(key):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True):
            yield int(key[a]), slice(a, b)


def _blobs(rows, kind: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["kind", "bucket", "data"])


BLOBS = "kind int, bucket int, data binary"


def _slices(length: int, window: int):
    """(ids, fingerprints' columns) of each slice of a stream of batches (id, text)."""

    def run(batches):
        for batch in batches:
            ids_all = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            off, _ = text_bytes(batch.column(1))
            for a, b in sliced(off, SLICE):
                bounds, raw = text_bytes(batch.column(1).slice(a, b - a))
                row, place, prints, marks = placed_anchors(bounds, raw, length, window)
                yield ids_all[a:b][row], place, prints, marks

    return run


def _several(length: int, window: int):
    """Texts -> fingerprints (mark null) and contexts that occur twice or more in a slice, with their number."""

    def run(batches):
        for _, _, prints, marks in _slices(length, window)(batches):
            order = np.lexsort((marks, prints))
            prints, marks = prints[order], marks[order]
            new = np.append(True, prints[1:] != prints[:-1])[: len(prints)]
            for fine in (False, True):
                first = np.flatnonzero(new | np.append(True, marks[1:] != marks[:-1])[: len(marks)] if fine else new)
                n = np.diff(np.append(first, len(prints)))
                first, n = first[n > 1], n[n > 1]
                mark = pa.array(marks[first].view(np.int64)) if fine else pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(prints[first].view(np.int64)), mark, pa.array(n, pa.int64())], names=["print", "mark", "n"])

    return run


@dataclass
class Hot:
    """Fingerprints, and contexts of them, that occur too often for one task; each has over HOT places, so there are few."""

    prints: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def pair(prints: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return mix(prints) ^ marks

    def of(self, prints: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the fingerprint is hot, and whether the context is."""
        if not len(self.prints):
            return np.zeros(len(prints), bool), np.zeros(len(prints), bool)
        return np.isin(prints, self.prints), np.isin(self.pair(prints, marks), self.pairs)


def hot_fingerprints(texts: DataFrame, length: int, window: int, hot: int) -> Hot:
    """What slices hold twice or more is counted; the rest adds at most one place for each slice."""
    counts = texts.mapInArrow(_several(length, window), "print bigint, mark bigint, n bigint").groupBy("print", "mark").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > hot).select("print", "mark").toArrow()  # at most (number of anchors) / hot rows
    fine = rows["mark"].is_valid().to_numpy()
    prints, marks = (rows[c].fill_null(0).to_numpy().astype(np.int64).view(np.uint64) for c in ("print", "mark"))
    return Hot(np.unique(prints), np.unique(Hot.pair(prints[fine], marks[fine])))


#: What is known of an anchor: its context is repeated; its context is to be fetched; and among too many to be put in order.
WHOLE, ASKED, CROWDED = 1, 2, 4


def _homes(docs: np.ndarray, places: np.ndarray, flags: np.ndarray, prints: np.ndarray, doc_buckets: int):
    """Anchors packed for their documents' buckets; fingerprints go along where the context is asked for."""
    home = (mix(docs.view(np.uint64)) % np.uint64(doc_buckets)).astype(np.int64)
    order = np.lexsort((places, docs, home))
    docs, places, flags, prints, home = docs[order], places[order], flags[order], prints[order], home[order]
    return _blobs([(k, pack(*pack_runs(docs[s]), places[s], flags[s], prints[s][(flags[s] & ASKED) > 0])) for k, s in _runs(home)], 1)


def _fingerprints(buckets: int, doc_buckets: int, length: int, window: int, shared):
    """Texts -> kind 0: anchors by bucket of the fingerprint, or of the context where that is hot; kind 1: anchors known to be repeated."""

    def run(batches):
        hot: Hot = shared.value
        for docs, place, prints, marks in _slices(length, window)(batches):
            hot_print, hot_pair = hot.of(prints, marks)
            if hot_pair.any():
                known = np.flatnonzero(hot_pair)
                yield _homes(docs[known], place[known], np.full(len(known), WHOLE, np.uint8), prints[known], doc_buckets)
                # One copy stays in the race: its context may be asked for.
                _, first = np.unique(Hot.pair(prints[known], marks[known]), return_index=True)
                keep = ~hot_pair
                keep[known[first]] = True
                docs, place, prints, marks, hot_print = docs[keep], place[keep], prints[keep], marks[keep], hot_print[keep]
            key = np.where(hot_print, mix(marks), prints)
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            docs, place, prints, marks = docs[order], place[order], prints[order], marks[order]
            yield _blobs([(k, pack(*pack_runs(docs[s]), place[s], prints[s], marks[s])) for k, s in _runs(bucket[order])])

    return run


def _repeated(doc_buckets: int, group_most: int, shared):
    """A bucket of fingerprints -> what is known of the anchors whose fingerprint occurs twice, to their documents' buckets."""

    def run(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == 1:
            return table.select(["kind", "bucket", "data"])
        parts = [unpack(blob) for blob in table["data"].to_pylist()]
        docs = np.concatenate([unpack_runs(a[0], a[1]) for a in parts])
        places, prints, marks = (np.concatenate([a[i].astype(k) for a in parts]) for i, k in ((2, np.int64), (3, np.uint64), (4, np.uint64)))
        del parts
        order = np.lexsort((places, docs, marks, prints))
        docs, places, prints, marks = docs[order], places[order], prints[order], marks[order]
        hot_print, hot_pair = shared.value.of(prints, marks)
        new_print = np.append(True, prints[1:] != prints[:-1])[: len(prints)]
        new_mark = new_print | np.append(True, marks[1:] != marks[:-1])[: len(marks)]
        of_print, of_mark = np.cumsum(new_print) - 1, np.cumsum(new_mark) - 1
        whole = (np.bincount(of_mark)[of_mark] > 1) | hot_pair if len(docs) else hot_pair
        different = np.bincount(of_print, new_mark).astype(np.int64)[of_print] if len(docs) else np.zeros(0, np.int64)
        asked = new_mark & ((different > 1) | hot_print)
        flags = whole * WHOLE + asked * ASKED + (asked & ((different > group_most) | hot_print)) * CROWDED
        some = np.flatnonzero(flags)
        return pa.Table.from_batches([_homes(docs[some], places[some], flags[some].astype(np.uint8), prints[some], doc_buckets)])

    return run


HITS = pa.schema([("doc", pa.int64()), ("whole", pa.binary()), ("asked", pa.binary()), ("crowded", pa.binary()), ("n_asked", pa.int64())])
HITS_DDL = "doc bigint, whole binary, asked binary, crowded binary, n_asked bigint"


def _by_document(table: pa.Table) -> pa.Table:
    """A bucket of documents -> places with a repeated context, and (place, fingerprint, whether repeated) of contexts to fetch."""
    parts = [unpack(blob) for blob in table["data"].to_pylist()]
    docs = np.concatenate([unpack_runs(a[0], a[1]) for a in parts])
    places, flags = (np.concatenate([a[i].astype(np.int64) for a in parts]) for i in (2, 3))
    prints = np.zeros(len(docs), np.uint64)
    prints[(flags & ASKED) > 0] = np.concatenate([a[4].astype(np.uint64) for a in parts])
    # A place that is known twice (a hot context's copy) keeps its row that asks.
    order = np.lexsort((-flags, places, docs))
    order = order[np.append(True, (docs[order][1:] != docs[order][:-1]) | (places[order][1:] != places[order][:-1]))[: len(order)]]
    docs, places, flags, prints = docs[order], places[order], flags[order], prints[order]
    out = {name: [] for name in HITS.names}
    for doc, s in _runs(docs):
        f = flags[s]
        wanted = lambda m, s=s, f=f: pack(places[s][m], prints[s][m], (f[m] & WHOLE).astype(np.uint8)) if m.any() else None
        crowded = (f & CROWDED) > 0
        ordered = ((f & ASKED) > 0) & ~crowded
        for name, v in zip(HITS.names, (doc, pack(places[s][(f & WHOLE) > 0]), wanted(ordered), wanted(crowded), int(ordered.sum())), strict=True):
            out[name].append(v)
    return pa.Table.from_pydict(out, HITS)


#: Bytes of contexts that are packed at once.
CONTEXT_BYTES = 4 << 20


def _contexts(parts: int, length: int, window: int):
    """Texts and what is asked of them -> contexts by bucket: ids, places, fingerprints, whether repeated, sizes left and right, bytes."""
    reach = length - window + 1

    def packed(rows, kind: int) -> pa.RecordBatch:
        prints = np.array([r[2] for r in rows], np.uint64)
        bucket = (mix(prints) % np.uint64(parts)).astype(np.int64) if kind == 0 else np.zeros(len(rows), np.int64)
        order = np.argsort(bucket, kind="stable")
        blobs = []
        for k, s in _runs(bucket[order]):
            some = [rows[i] for i in order[s].tolist()]
            ids, places, whole, left, right = (np.array([r[i] for r in some], np.int64) for i in (0, 1, 3, 4, 5))
            data = b"".join(r[6] for r in some)
            small = pa.compress(data, codec="zstd", asbytes=True)
            blobs.append((k, pack(*pack_runs(ids), places, prints[order[s]], whole, left, right, np.array([len(data)]), np.frombuffer(small, np.uint8))))
        return _blobs(blobs, kind)

    def run(batches):
        for batch in batches:
            texts, rows, size = batch.column(1).cast(pa.large_binary()), ([], []), [0, 0]
            for i, (doc, *wanted) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                data = texts[i].as_py() or b""
                for kind, blob in enumerate(wanted):
                    for p, fingerprint, whole in zip(*(a.tolist() for a in unpack(blob)), strict=True) if blob else ():
                        left = data[max(0, p - window + 1) : p]
                        # Crowded contexts are hashed as they are; others agree on what follows the anchor.
                        right = data[p + reach * (kind == 0) : p + length]
                        rows[kind].append((doc, p, fingerprint, whole, len(left), len(right), left + right))
                        size[kind] += len(left) + len(right)
                    if rows[kind] and (size[kind] > CONTEXT_BYTES or i + 1 == batch.num_rows):
                        yield packed(rows[kind], kind)
                        rows[kind].clear()
                        size[kind] = 0

    return run


def _unpacked(blob: bytes):
    """(docs, places, fingerprints, whether repeated, lefts, rights) of packed contexts."""
    steps, runs, place, prints, whole, left, right, size, small = unpack(blob)
    data = pa.decompress(small.tobytes(), int(size[0]), codec="zstd", asbytes=True)
    middle = np.cumsum(left.astype(np.int64) + right) - right
    cut = list(zip((middle - left).tolist(), middle.tolist(), (middle + right).tolist(), strict=True))
    return unpack_runs(steps, runs), place.astype(np.int64), prints.astype(np.uint64), whole.astype(bool), [data[a:b] for a, b, _ in cut], [data[b:c] for _, b, c in cut]


class RangeLeast:
    """The least value of any range of an array, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a:b], for a < b."""
        k = np.floor(np.log2(b - a)).astype(np.int64)
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.unique(k).tolist():
            m = k == level
            out[m] = np.minimum(self.levels[level][a[m]], self.levels[level][b[m] - (1 << level)])
        return out


def repeated_places(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], counts: np.ndarray, length: int, window: int) -> np.ndarray:
    """Which strings occur twice: a matrix [context, offset]; the string of an offset starts that many bytes left of the anchor.

    groups: contexts of one group agree on the length - window + 1 bytes from
    the anchor on, which rights leave out. counts: occurrences of each context.
    """
    n, reach = len(groups), length - window + 1
    repeated = np.zeros((n, window), bool)
    if not n:
        return repeated
    # Blocks of the rights as symbols in order of their bytes; 0 ends a context.
    cut = [[r[b : b + BLOCK] for b in range(0, len(r), BLOCK)] for r in rights]
    rank_of = {b: k + 1 for k, b in enumerate(sorted({b for c in cut for b in c}))}
    text, starts = [], []
    for c in cut:
        starts.append(len(text))
        text += [rank_of[b] for b in c]
        text.append(0)
    at = {s: i for i, s in enumerate(starts)}
    ordered = np.array([at[s] for s in suffix_array(text) if s in at])
    order = ordered[np.argsort(groups[ordered], kind="stable")]
    # Agreement to the right of neighbours in this order.
    sizes = np.array([len(r) for r in rights])[order]
    matrix = np.zeros((n, window), np.uint8)
    for k, i in enumerate(order.tolist()):
        matrix[k, : len(rights[i])] = np.frombuffer(rights[i], np.uint8)
    agree = np.zeros(max(n - 1, 1), np.int64)
    for a in range(0, n - 1, 4096):
        b = min(n - 1, a + 4096)
        differ = matrix[a + 1 : b + 1] != matrix[a:b]
        run = np.where(differ.any(1), differ.argmax(1), window)
        agree[a:b] = reach + np.minimum(run, np.minimum(sizes[a:b], sizes[a + 1 : b + 1]))
    del matrix
    sizes = reach + sizes
    least = RangeLeast(agree)
    left_size = np.array([len(x) for x in lefts])[order]
    left = np.zeros((n, window), np.uint8)
    for k, i in enumerate(order.tolist()):
        left[k, : len(lefts[i])] = np.frombuffer(lefts[i], np.uint8)[::-1]
    count, kind = counts[order], groups[order]
    kind = np.cumsum(np.append(0, kind[1:] != kind[:-1]))
    active = np.arange(n)
    for offset in range(window):
        if offset:
            # Texts that end here leave; the others part by the byte before.
            stay = left_size[active] >= offset
            active, kind = active[stay], kind[stay] * 256 + left[active[stay], offset - 1]
            new = np.argsort(kind, kind="stable")
            active, kind = active[new], kind[new]
            kind = np.cumsum(np.append(0, kind[1:] != kind[:-1])) if len(kind) else kind
        if not len(active):
            break
        best = np.where(count[active] > 1, sizes[active], 0)
        next_same = np.flatnonzero(kind[1:] == kind[:-1])
        if len(next_same):
            common = least(active[next_same], active[next_same + 1])
            np.maximum.at(best, next_same, common)
            np.maximum.at(best, next_same + 1, common)
        repeated[order[active], offset] = best + offset >= length
        alone = np.ones(len(active), bool)
        alone[next_same] = alone[next_same + 1] = False
        on = ~alone | (count[active] > 1)
        active, kind = active[on], kind[on]
    return repeated


def spans_of(repeated: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context the byte ranges, from the anchor, that its repeated strings cover."""
    out = []
    for row in repeated:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        for low, high in zip(edge[::2].tolist()[::-1], edge[1::2].tolist()[::-1], strict=True):
            a, b = -(high - 1), length - low
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        out.append(spans)
    return out


FOUND = "doc bigint, a bigint, b bigint"


def _found(docs, places, spans) -> pa.RecordBatch:
    """Spans from the anchor as ranges of the document."""
    flat = [(d, p + a, p + b) for d, p, s in zip(docs, places, spans, strict=True) for a, b in s]
    cols = list(zip(*flat, strict=True)) if flat else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "a", "b"])


def _order(length: int, window: int):
    """A bucket of contexts -> ranges to remove of those that aren't known to be repeated whole."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(blob) for blob in table["data"].to_pylist()]
        docs, places, prints, whole = (np.concatenate([p[i] for p in parts]) for i in range(4))
        lefts, rights = ([x for p in parts for x in p[i]] for i in (4, 5))
        del parts
        _, groups = np.unique(prints, return_inverse=True)
        spans = spans_of(repeated_places(groups, lefts, rights, 1 + whole.astype(np.int64), length, window), length)
        some = [i for i in range(len(docs)) if spans[i] and not whole[i]]
        return pa.Table.from_batches([_found([docs[i] for i in some], [places[i] for i in some], [spans[i] for i in some])])

    return run


#: Neighbouring offsets whose strings are first counted by what they have in common.
STEP = 32
CROWD = "doc bigint, place bigint, left int, print bigint, n int, context binary"
STRINGS = "doc bigint, place bigint, offset int, n int"


def _crowd(batches):
    """Packed contexts -> one row for each, n being 2 if it is known to be repeated."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            docs, places, prints, whole, lefts, rights = _unpacked(blob)
            cols = (docs, places, [len(x) for x in lefts], prints.view(np.int64), 1 + whole.astype(np.int32), [a + b for a, b in zip(lefts, rights, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["doc", "place", "left", "print", "n", "context"])


#: Hashes that a task gathers before it hands them on.
HASHES_AT_ONCE = 20_000


def _hashes(rows, kind: pa.DataType):
    """Batches of (doc, place, offset, n, h)."""
    while some := list(islice(rows, HASHES_AT_ONCE)):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), types, strict=True)], names=["doc", "place", "offset", "n", "h"])


def _blocks(length: int):
    """Contexts -> for each block of offsets a short hash of what its strings have in common; it may be equal by chance."""

    def rows(batches):
        for batch in batches:
            for doc, place, left, fingerprint, n, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for j in range(left // STEP + 1):
                    a, b = left - j * STEP, left - j * STEP - STEP + 1 + length
                    if b <= len(context):
                        yield doc, place, j, n, xxhash.xxh3_64_intdigest(context[a:b], seed=(fingerprint + j) & (1 << 64) - 1) >> 1

    return lambda batches: _hashes(rows(batches), pa.int64())


def _strings(length: int):
    """Contexts and blocks of offsets -> one row for each string, its hash."""

    def rows(batches):
        for batch in batches:
            for doc, place, left, fingerprint, n, context, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A string counts once for each place of the anchor, so fingerprint and offset are part of its name.
                name = fingerprint.to_bytes(8, "big", signed=True)
                for o in (o for j in wanted for o in range(j * STEP, min(left, j * STEP + STEP - 1) + 1)):
                    if left - o + length <= len(context):
                        yield doc, place, o, n, xxhash.xxh3_128_digest(name + o.to_bytes(4, "big") + context[left - o : left - o + length])

    return lambda batches: _hashes(rows(batches), pa.binary())


def _twice(strings: DataFrame) -> DataFrame:
    """(doc, place, offset) of hashes that occur twice. Hashes are written first, so that the join is of plain exchanges and a hot one's rows can be split."""
    strings = stored(strings, "strings")
    often = stored(strings.groupBy("h").agg(F.sum("n").alias("m")).where("m > 1").select(F.col("h").alias("_h")), "often")
    return strings.join(often, F.col("h") == F.col("_h"), "left_semi").select("doc", "place", "offset")


def _crowded_ranges(packed: DataFrame, length: int) -> DataFrame:
    """The ranges to remove that lie in contexts of crowded fingerprints."""
    contexts = stored(packed.mapInArrow(_crowd, CROWD), "crowd")  # one Python worker a task at a time: each stage has one map
    blocks = _twice(contexts.mapInArrow(_blocks(length), f"{STRINGS}, h bigint")).groupBy(F.col("doc").alias("_d"), F.col("place").alias("_p")).agg(F.collect_set("offset").alias("wanted"))
    wanted = contexts.join(blocks, (F.col("doc") == F.col("_d")) & (F.col("place") == F.col("_p"))).select("doc", "place", "left", "print", "n", "context", "wanted")
    strings = _twice(wanted.mapInArrow(_strings(length), f"{STRINGS}, h binary"))
    # All strings of a context overlap (offsets are less than `length` apart), so they cover one range.
    return strings.groupBy("doc", "place").agg((F.col("place") - F.max("offset")).alias("a"), (F.col("place") - F.min("offset") + length).alias("b")).select("doc", "a", "b")


def repeated_spans(documents: DataFrame, id_column: str, text_column: str, length: int = LENGTH, window: int = WINDOW, group_most: int = GROUP_MOST, hot: int = HOT) -> DataFrame:
    """(_d, whole, spans): for each id the places of repeated contexts, packed, and further byte ranges to remove, not yet merged."""
    rows, size = volume(documents, text_column)
    buckets, doc_buckets = max(1, -(-size // BUCKET_BYTES)), max(1, -(-rows // BUCKET_DOCS))
    texts = documents.where(F.col(id_column).isNotNull() & (F.octet_length(text_column) >= length)).select(F.col(id_column).cast("bigint").alias("doc"), F.col(text_column).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(hot_fingerprints(texts, length, window, hot))
    known = texts.mapInArrow(_fingerprints(buckets, doc_buckets, length, window, shared), BLOBS).groupBy("kind", "bucket").applyInArrow(_repeated(doc_buckets, group_most, shared), BLOBS)
    hits = stored(known.groupBy("bucket").applyInArrow(_by_document, HITS_DDL), "hits")
    n, crowded = hits.agg(F.coalesce(F.sum("n_asked"), F.lit(0)), F.count("crowded")).first()
    asked = hits.where("asked is not null or crowded is not null").select(F.col("doc").alias("_d"), "asked", "crowded")
    contexts = texts.join(asked, F.col("doc") == F.col("_d")).select("doc", "text", "asked", "crowded").mapInArrow(_contexts(max(1, -(-n // 10_000)), length, window), BLOBS)
    if crowded:
        contexts = stored(contexts, "contexts")
    found = contexts.where("kind = 0").groupBy("bucket").applyInArrow(_order(length, window), FOUND)
    if crowded:
        found = found.unionByName(_crowded_ranges(contexts.where("kind = 1").select("data"), length))
    found = stored(found, "found")
    if crowded:
        discard(contexts)
    found = found.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return hits.select(F.col("doc").alias("_d"), "whole").join(found, F.col("_d") == F.col("doc"), "left").select("_d", "whole", "spans")


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Ranges that overlap or touch, joined."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    first = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[first].tolist(), reach[np.append(first[1:] - 1, len(reach) - 1)].tolist(), strict=True))


CUT = "n_bytes bigint, removed array<struct<a:bigint,b:bigint>>, n_removed bigint, kept binary, kept_sha256 string"


def without_repeats(documents: DataFrame, keep: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True, **options) -> DataFrame:
    """Each row: row (struct of `keep`, all columns by default) and found: n_bytes, removed (byte ranges), n_removed, kept (the bytes left; null unless with_text), kept_sha256.

    options: those of repeated_spans.
    """
    keep = list(keep or documents.columns)
    length, window = options.get("length", LENGTH), options.get("window", WINDOW)
    spans = repeated_spans(documents, id_column, text_column, **options)
    joined = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(id_column).cast("bigint").alias("_id"), F.col(text_column).alias("_text")).join(
        spans, F.col("_id") == F.col("_d"), "left").select("row", "_text", "whole", "spans")
    row_type = joined.schema["row"].dataType

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            out = []
            for i, (whole, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                data = texts[i].as_py() or b""
                at = unpack(whole)[0].astype(np.int64) if whole else np.zeros(0, np.int64)
                starts = np.concatenate([np.maximum(0, at - window + 1), np.array([s["a"] for s in spans or ()], np.int64)])
                stops = np.concatenate([np.minimum(len(data), at + length), np.array([s["b"] for s in spans or ()], np.int64)])
                cut = merged(starts, stops)
                kept, last = [], 0
                for a, b in cut:
                    kept.append(data[last:a])
                    last = b
                kept = b"".join([*kept, data[last:]])
                out.append({"n_bytes": len(data), "removed": [{"a": a, "b": b} for a, b in cut], "n_removed": len(data) - len(kept), "kept": kept if with_text else None, "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, found_arrow)], names=["row", "found"])

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    found_type = T.StructType.fromDDL(CUT)
    found_arrow = to_arrow_type(found_type)
    return joined.mapInArrow(run, T.StructType([T.StructField("row", row_type), T.StructField("found", found_type)]))


__all__ = ["repeated_places", "repeated_spans", "spans_of", "without_repeats"]
