"""Benchmark decontamination by suffix arrays over the training texts.

Each slice of a partition is a shard: its words become benchmark word ids (0
for every other word), the suffixes that can start a match are sorted into a
suffix array, and every suffix of every benchmark item is looked up in it by
binary search. What lies between the two bounds are the verbatim occurrences;
neighbouring occurrences along a diagonal join into the longest match, so a
search needs to compare no more than a window's words. Shards are independent,
so the plan is scan -> Arrow map: no shuffle.

A window is `size` consecutive words of an item; an item of fewer words, but
not none, is one window. A document word inside any occurrence is hit.

The benchmark is the only thing sent to executors. Its size is checked: it goes
out in blocks of at most BLOCK_BYTES of text, each block a broadcast of flat
arrays and a further map over the same rows, so memory is bounded however large
it is, and the driver holds one block at a time. Results don't depend on where
blocks are cut.

Defined cases: null and empty texts have no words and no hits; null items and
items without words match nothing; equal items all count, and rows of one item
id are one item; repeated document rows each get their result; other columns
pass through `row` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import annotate
from .words import ALNUM, Words

SIZE = 10
BLOCK_BYTES = 8 << 20


class Probes:
    """Every suffix of a block of benchmark items, up to `size` words of it, in flat arrays."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size = size
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        names, at = np.unique(np.array([i for i, _ in items], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
        self.items: list[str] = names.tolist()
        self.vocab = pa.array(words.vocab, pa.binary())
        counts = words.counts()
        lengths = np.minimum(size, counts)
        suffixes = counts - lengths + (lengths > 0)
        row = np.repeat(np.arange(len(items)), suffixes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
        keys = keys_at(words.codes + 1, words.offsets[row] + place, words.offsets[row + 1], size) if len(row) else np.zeros((0, size), ">u4")
        flat = keys.view(f"S{4 * size}").ravel()
        self.keys, self.of = np.unique(flat, return_inverse=True)
        #: Item and place of the owners of each key, in the keys' order.
        order = np.argsort(self.of, kind="stable")
        self.owner, self.place = at[row][order], place[order]
        self.first_owner = np.searchsorted(self.of[order], np.arange(len(self.keys) + 1))
        del self.of
        _, once = np.unique(flat, return_index=True)
        self.lengths = lengths[row][once]
        # Bitmaps over first words and hashed pairs: a superset of where a match can start.
        starts = keys[once].astype(np.int64)
        self.first = np.zeros(len(words.vocab) + 1, bool)
        self.first[starts[self.lengths == 1, 0]] = True
        pairs = starts[self.lengths > 1, :2]
        self.bits = max(16, int(len(pairs) * 16).bit_length())
        self.pair = np.zeros(1 << self.bits, bool)
        if len(pairs):
            self.pair[self.slot(pairs[:, 0], pairs[:, 1])] = True

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - self.bits)).astype(np.int64)


def keys_at(ids: np.ndarray, at: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The `size` word ids from each place, big-endian; 0 beyond its row's end."""
    padded = np.append(ids, np.zeros(size, np.int64))
    keys = np.empty((len(at), size), ">u4")
    for j in range(size):
        keys[:, j] = np.where(at + j < ends, padded[at + j], 0)
    return keys


def occurrences(words: Words, probes: Probes) -> tuple[np.ndarray, np.ndarray]:
    """(word position, probe index) of each verbatim occurrence in the shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words) or not len(probes.keys):
        return none
    known = pc.index_in(pa.array(words.vocab, pa.binary()), probes.vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ids = known[words.codes]
    size = probes.size
    rows_end = np.repeat(words.offsets[1:], words.counts())
    at = np.flatnonzero(ids)
    following = np.append(ids, 0)[at + 1]
    may = probes.first[ids[at]] | (probes.pair[probes.slot(ids[at], following)] & (following > 0) & (at + 1 < rows_end[at]))
    at = at[may]
    if not len(at):
        return none
    suffixes = keys_at(ids, at, rows_end[at], size).view(f"S{4 * size}").ravel()
    order = np.argsort(suffixes, kind="stable")  # the suffix array of the shard
    array = suffixes[order]
    # A shorter item's window is a prefix: it spans to the last suffix that starts with it.
    upper = probes.keys.copy()
    raw = upper.view(np.uint8).reshape(-1, 4 * size)
    raw[np.arange(4 * size) >= 4 * probes.lengths[:, None]] = 255
    low, high = np.searchsorted(array, probes.keys, "left"), np.searchsorted(array, upper, "right")
    n = high - low
    place = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    return at[order[place]], np.repeat(np.arange(len(n)), n)


def longest(at: np.ndarray, probe: np.ndarray, probes: Probes, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, start in the shard, start in the item, words) of each longest verbatim match: occurrences joined along diagonals."""
    n = np.diff(probes.first_owner)[probe]
    owners = np.arange(n.sum()) + np.repeat(probes.first_owner[probe] - (np.cumsum(n) - n), n)
    at, length = np.repeat(at, n), np.repeat(probes.lengths[probe], n)
    item, place = probes.owner[owners], probes.place[owners]
    row = rows[at] if len(at) else at
    order = np.lexsort((at, at - place, item, row))
    row, item, at, place, length = row[order], item[order], at[order], place[order], length[order]
    diagonal = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]))[: len(at)]
    # The furthest stop so far on a diagonal; rows of one item id may have windows of several lengths there.
    apart = np.cumsum(diagonal) * (int(at.max(initial=0)) + probes.size + 1)
    stop = np.maximum.accumulate(at + length + apart) - apart if len(at) else at
    new = diagonal | np.append(True, at[1:] > stop[:-1])[: len(at)]
    first = np.flatnonzero(new)
    words = np.maximum.reduceat(stop, first) - at[first] if len(first) else first
    return row[first], item[first], at[first], place[first], words


def _marked(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


FIELDS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>, longest bigint"


def _scan(shared, text_column: str):
    def make():
        probes: Probes = shared.value

        def f(texts):
            words = Words(texts, ALNUM)
            at, probe = occurrences(words, probes)
            hit = _marked(len(words), at, probes.lengths[probe])
            sums = np.append(0, np.cumsum(hit))
            row, item, _, _, size = longest(at, probe, probes, words.rows())
            most = np.zeros(len(texts), np.int64)
            np.maximum.at(most, row, size)
            items: list[list[str]] = [[] for _ in range(len(texts))]
            for r, i in np.unique(np.stack([row, item], 1), axis=0).tolist() if len(row) else ():  # items are numbered in the order of their names
                items[r].append(probes.items[i])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            # A run must not cross from one row into the next.
            cuts = words.offsets[1:-1][(words.offsets[1:-1] > 0) & (words.offsets[1:-1] < len(words))]
            cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]]) if len(cuts) else cuts
            starts, stops = np.sort(np.append(edge[::2], cuts)), np.sort(np.append(edge[1::2], cuts))
            spans: list[list] = [[] for _ in range(len(texts))]
            for a, b, r in zip(starts.tolist(), stops.tolist(), (np.searchsorted(words.offsets, starts, "right") - 1).tolist(), strict=True):
                spans[r].append({"start": a - int(words.offsets[r]), "stop": b - int(words.offsets[r])})
            return [words.counts(), sums[words.offsets[1:]] - sums[words.offsets[:-1]], items, spans, most]

        return f

    return make


def longest_matches(texts, items: list[tuple[str, str]], size: int = SIZE) -> list[tuple[int, str, int, int, int]]:
    """(row, item, start in the text, start in the item, words) of each longest verbatim match of one shard."""
    probes, words = Probes(items, size), Words(texts, ALNUM)
    found = longest(*occurrences(words, probes), probes, words.rows())
    return sorted((r, probes.items[i], a - int(words.offsets[r]), p, n) for r, i, a, p, n in zip(*(x.tolist() for x in found), strict=True))


def blocks(benchmark: DataFrame, id_column: str, text_column: str, most: int = BLOCK_BYTES):
    """The items in blocks of at most `most` bytes of text, one longer item being a block of its own."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_column).cast("string").alias("i"), F.col(text_column).alias("t")).where("i is not null and t is not null").orderBy("i", "t")
    for r in rows.toLocalIterator():
        if block and size + len(r.t.encode()) > most:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t.encode())
    if block:
        yield block


#: SQL that joins two sorted lists of word ranges.
UNITED = (
    "aggregate(array_sort(concat(row._found.spans, found.spans)), cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, s) -> "
    "if(size(acc) > 0 and s.start <= element_at(acc, -1).stop, "
    "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, s.stop)))), "
    "concat(acc, array(s))))"
)


def contamination(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, size: int = SIZE,
                  text_column: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document row: row (struct of `keep`, all columns by default) and found.

    found: n_words, n_hit, items (ids of items with an occurring window, as
    sorted strings), spans (word ranges that are hit) and longest (words of the
    longest verbatim match with any item).
    """
    keep = list(keep or documents.columns)
    sc, out = documents.sparkSession.sparkContext, None
    work = f"_text_{'_'.join(keep)}"  # clashes with no kept column
    for block in blocks(benchmark, item_id, item_text, block_bytes):
        shared = sc.broadcast(Probes(block, size))
        if out is None:
            out = annotate(documents.withColumn(work, F.col(f"`{text_column}`")), work, [*keep, work], _scan(shared, work), FIELDS)
            continue
        flat = out.select(*[F.col(f"row.`{c}`").alias(c) for c in [*keep, work]], F.col("found").alias("_found"))
        nxt = annotate(flat, work, [*keep, work, "_found"], _scan(shared, work), FIELDS)
        out = nxt.select(
            F.struct(*[F.col(f"row.`{c}`").alias(c) for c in [*keep, work]]).alias("row"),
            F.expr(f"named_struct('n_words', found.n_words, 'n_hit', aggregate({UNITED}, 0L, (n, s) -> n + s.stop - s.start), "
                   f"'items', array_sort(array_union(row._found.items, found.items)), 'spans', {UNITED}, 'longest', greatest(row._found.longest, found.longest))").alias("found"),
        )
    if out is None:
        return annotate(documents, text_column, keep, _scan(sc.broadcast(Probes([], size)), text_column), FIELDS)
    return out.select(F.struct(*[F.col(f"row.`{c}`").alias(c) for c in keep]).alias("row"), "found")


def items_digest(items: F.Column) -> F.Column:
    return F.sha2(F.concat_ws(",", items), 256)


def decontaminated(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents, all columns, without those that a benchmark window occurs in."""
    return contamination(documents, benchmark, size=size).where("found.n_hit = 0").select("row.*")


__all__ = ["blocks", "contamination", "decontaminated", "items_digest", "longest_matches", "occurrences"]
