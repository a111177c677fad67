"""SHA-256 digests of the joined members of groups of any size.

A digest reads its group from first to last, so it can't be split; what can be
split is all before it. Rows are partitioned by ranges of (group, order) and
sorted, so that a large group lies in several tasks. A task joins the members
of each group as they stream by: a small group that lies within the task is
hashed there, one that is large or touches an edge of the task leaves pieces
of joined bytes. Only the pieces of these meet by group, in order, and are
hashed one by one. No task ever holds more than a piece of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of joined members in a piece.
PIECE_BYTES = 16 << 10


def runs(key: pa.Array) -> list[tuple[int, int]]:
    """The runs of equal rows of a struct array."""
    ends = {len(key)}
    for field in key.flatten():
        ends.update(pc.run_end_encode(field).run_ends.to_pylist())
    starts = [0, *sorted(ends)]
    return [(a, b) for a, b in zip(starts, starts[1:], strict=False) if b > a]


class Pieces:
    """The group that streams by: its key, what isn't handed on yet, and whether anything was."""

    def __init__(self, key: pa.Scalar, first: bool):
        self.key, self.open, self.held, self.size, self.n = key, first, [], 0, 0

    def add(self, joined: bytes, n: int) -> bool:
        """True if what is held makes a piece."""
        self.held.append(joined)
        self.size += len(joined)
        self.n += n
        return self.size >= PIECE_BYTES

    def take(self, separator: bytes) -> tuple[bytes, int]:
        out = separator.join(self.held), self.n
        self.held, self.size, self.n = [], 0, 0
        return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array([v.as_py() if isinstance(v, pa.Scalar) else v for v in c], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def joined_digests(rows: DataFrame, by: list[str], item: str, order: list[Column] | None = None, separator: str = ",") -> DataFrame:
    """(by, n, sha256): the number of members of each group and the digest of their texts, joined in order.

    Members are cast to strings and stand in the order given, their own by
    default; null members are left out. rows is read twice: once to find the
    ranges.
    """
    glue = separator.encode()
    key = F.struct(*[F.col(f"`{c}`") for c in by])
    ordered = rows.where(F.col(item).isNotNull()).select(key.alias("k"), F.struct(*(order or [F.col(item)])).alias("o"), F.col(item).cast("string").alias("m"))
    spread = ordered.repartitionByRange("k", "o").sortWithinPartitions("k", "o").select("k", "m")
    fields = [T.StructField("k", spread.schema["k"].dataType), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("piece", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sha256", T.StringType())]
    pieces, digests = T.StructType(fields), T.StructType([fields[0], *fields[4:]])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part, seq, group = to_arrow_schema(pieces), TaskContext.get().partitionId(), 0, None
        for batch in batches:
            out, key, member = [], batch.column(0), batch.column(1)
            for a, b in runs(key):
                if group is None or key[a] != group.key:
                    if group is not None and group.open and group.held:
                        out.append((group.key, part, seq, *group.take(glue), None))
                    elif group is not None and not group.open:
                        joined, n = group.take(glue)
                        out.append((group.key, None, None, None, n, hashlib.sha256(joined).hexdigest()))
                    seq, group = seq + 1, Pieces(key[a], group is None)
                for at in range(a, b, 1024):
                    some = member[at : min(b, at + 1024)].to_pylist()
                    if group.add(separator.join(some).encode(), len(some)):
                        out.append((group.key, part, seq, *group.take(glue), None))
                        seq, group.open = seq + 1, True
            if out:
                yield _batch(out, schema)
        if group is not None and group.held:
            yield _batch([(group.key, part, seq, *group.take(glue), None)], schema)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, digest, n = to_arrow_schema(digests), None, None, 0
        for batch in batches:
            out = []
            for i in range(len(batch)):
                if batch.column(3)[i].is_valid:
                    out.append((batch.column(0)[i], batch.column(2)[i], batch.column(3)[i]))
                    continue
                if key is None or batch.column(0)[i] != key:
                    if key is not None:
                        out.append((key, n, digest.hexdigest()))
                    key, digest, n = batch.column(0)[i], hashlib.sha256(), 0
                if n:
                    digest.update(glue)
                digest.update(batch.column(1)[i].as_py())
                n += batch.column(2)[i].as_py()
            if out:
                yield _batch(out, schema)
        if key is not None:
            yield _batch([(key, n, digest.hexdigest())], schema)

    met = spread.mapInArrow(join, pieces).repartition("k").sortWithinPartitions("k", "part", "seq").select("k", "piece", "n", "sha256")
    return met.mapInArrow(fold, digests).select("k.*", "n", "sha256")
