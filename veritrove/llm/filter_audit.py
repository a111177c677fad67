"""Filter interaction audit: what each filter removes, alone and after others, for every order of the filters.

1. Routing. An RDD of documents is partitioned by the xxhash of their texts.
   A partition keeps collision chains: for each fingerprint the different full
   texts that have it, each with its smallest id. Ids that aren't the smallest
   of their text are emitted as copies, whatever the order in which rows come.
   Copies within a slice of SLICE_BYTES of a task's rows are settled there, so
   of a large group one row for each slice travels; settled rows carry no text
   and are dealt by id.
2. Masks. A document's failures are one bit for each filter; the four filters
   of the text are taken while it is routed, the fifth is being a copy.
3. Counts. combineByKey adds (mask, documents, good, toxic) to one vector of
   32 counts for each part and measure; map-side first, so a hot part costs a
   row for each task. Every order, step and Shapley sum follows from these.

Defined cases: a null text is an empty one and a null source the empty part;
empty texts are copies of each other; a row without an id is a copy of any row
that has one and its text, never of another without; rows of one id and one
text are no copies of each other and count as often as they are there; a label
holds if any row of `labels` for that id has it, and an id without one has
neither; an empty table has no parts and no rows; other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import volume

#: Filters in the order of their bits; the last is being a copy of a smaller id's text.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
SIZE = 1 << len(FILTERS)
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Bytes of text in a slice of a task's rows, and in a partition of routed texts.
SLICE_BYTES, ROUTED_BYTES = 16 << 20, 32 << 20
#: Stands for a missing id: above all others.
NO_ID = 1 << 63


def failures(raw: bytes, length: int) -> int:
    """The bits of the filters that a text of so many code points fails; bytes.split() parts words at \\x20 and \\x09-\\x0D."""
    words = raw.split()
    few = len(words) < LEAST_WORDS
    repetitive = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITALS_PERCENT * length
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return few | repetitive << 1 | loud << 2 | marked << 3


class Chains:
    """Different texts by fingerprint, each with its smallest id, the mask and that id's rows by part."""

    def __init__(self):
        self.of: dict[int, list[list]] = {}

    def add(self, fingerprint: int, raw: bytes, doc: int, mask: int, parts: dict[str, int]) -> tuple | None:
        """Takes a row in; (id, mask, rows by part) of the one that is now known to be a copy, if any."""
        chain = self.of.setdefault(fingerprint, [])
        for link in chain:
            if link[0] == raw:
                if doc == link[1]:
                    link[3] = {p: link[3].get(p, 0) + parts.get(p, 0) for p in link[3] | parts}
                    return None
                out = (max(doc, link[1]), mask | COPY, link[3] if doc < link[1] else parts)
                if doc < link[1]:
                    link[1:] = [doc, mask, parts]
                return out
        chain.append([raw, doc, mask, parts])
        return None

    def rows(self) -> Iterator[tuple[int, bytes, int, int, dict[str, int]]]:
        return ((f, *link) for f, chain in self.of.items() for link in chain)


def _route(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(fingerprint, (text, id, mask, rows by part)) of the smallest ids of a slice; settled copies have no text."""
    chains, size = Chains(), 0
    settled = lambda out: (xxhash.xxh3_64_intdigest(out[0].to_bytes(9, "big", signed=True)), (None, *out))
    for doc, text, part in rows:
        raw = text.encode()
        size += len(raw)
        if out := chains.add(xxhash.xxh3_64_intdigest(raw), raw, NO_ID if doc is None else doc, failures(raw, len(text)), {part: 1}):
            yield settled(out)
        if size >= SLICE_BYTES:
            yield from ((f, rest) for f, *rest in chains.rows())
            chains, size = Chains(), 0
    yield from ((f, rest) for f, *rest in chains.rows())


def _settle(routed: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int | None, int, str, int]]:
    """A partition of routed rows -> (id, mask, part, rows)."""
    chains = Chains()

    def told(doc, mask, parts):
        return ((None if doc == NO_ID else doc, mask, part, n) for part, n in parts.items())

    for fingerprint, (raw, doc, mask, parts) in routed:
        if raw is None:
            yield from told(doc, mask, parts)
        elif out := chains.add(fingerprint, raw, doc, mask, parts):
            yield from told(*out)
    for _, _, doc, mask, parts in chains.rows():
        yield from told(doc, mask, parts)


def failure_masks(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(id, mask, part, n): the filters that each document fails, with the number of its rows in each part."""
    _, size = volume(documents, text_column)
    spark = documents.sparkSession
    partitions = max(-(-size // ROUTED_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = documents.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), text(text_column).alias("text"), text(part_column).alias("part")).rdd
    settled = rows.mapPartitions(_route).partitionBy(partitions, lambda fingerprint: fingerprint).mapPartitions(_settle)
    return spark.createDataFrame(settled, "id bigint, mask int, part string, n bigint", verifySchema=False)


def later_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ids that aren't the smallest of their text, once for each row."""
    found = failure_masks(documents, id_column, text_column, text_column).where(F.col("mask").bitwiseAND(COPY) > 0)
    return found.select(F.explode(F.array_repeat("id", F.col("n").cast("int"))).alias(id_column))


def _count(counts: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
    mask, n, good, toxic = row
    counts[:, mask] += (n, n * good, n * toxic)
    return counts


def mask_counts(masks: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> RDD:
    """(part, counts): counts[measure, mask] of documents, good ones and toxic ones."""
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("bigint").alias("_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = masks.join(known, F.col("id") == F.col("_id"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))).rdd
    partitions = int(masks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.map(lambda r: (r[0], r[1:])).combineByKey(lambda row: _count(np.zeros((3, SIZE), np.int64), row), _count, np.add, partitions)


def interactions(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """Every order's steps, from the counts by mask."""
    n, good, toxic = counts
    masks = np.arange(SIZE)
    orders = list(permutations(FILTERS))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    # In 1 of k orders a given one of k failing filters comes first and removes the document.
    firsts = [len(orders) // max(1, m.bit_count()) for m in range(SIZE)]
    shapley = {f: int((n * firsts)[masks & b > 0].sum()) for f, b in bit.items()}
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            fails, still = masks & bit[f] > 0, masks & before == 0
            here = fails & still
            figures = (n[still & ~fails], n[here], n[fails & ~still], n[masks == bit[f]], good[here], toxic[here])
            yield (part, "".join(order), step, *(int(x.sum()) for x in figures), shapley[f])
            before |= bit[f]


AUDIT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def filter_audit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step."""
    counts = mask_counts(failure_masks(documents, id_column, text_column, part_column), labels, id_column)
    return documents.sparkSession.createDataFrame(counts.flatMap(lambda x: interactions(*x)), AUDIT, verifySchema=False)
