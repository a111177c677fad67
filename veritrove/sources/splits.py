"""Records of large JSON files, read by many tasks and numbered in file order.

An array file is read as pieces that end at closing braces, which Spark's text
source finds in byte ranges of the file. What a range means depends on what
stands before it: whether it begins inside a string, and how deep. So a first
pass sums up each range - the parity of its quotes and, for both parities, its
change of depth and its commas by depth - and running sums over the ranges give
each one's place. The second pass cuts records at the commas of the array
itself; a record that lies across ranges comes in parts, which meet by its
number. Only a row for each range reaches the driver. Where the array is a
member of an object, a pass between these collects what stands outside the
members' own brackets, which tells the array's place among them.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = 34, 92, 44, (91, 123), (93, 125)


class Start(NamedTuple):
    """What stands before a range: the parity of quotes, the depth, the number of the record at its beginning and that of the object's member."""

    parity: int
    depth: int
    number: int
    member: int = 0


def text_pieces(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """(path, size, block, value): pieces of files up to each `end`, with the start of the byte range that they are read from."""
    m = F.col("_metadata")
    return spark.read.option("lineSep", end).text(path).select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_block_start"].alias("block"), "value")


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], pa.Array]]:
    """(path, size, block) and pieces of each stretch of a batch that is of one range."""
    for batch in batches:
        path, size, block, value = batch.columns
        blocks = block.to_numpy()
        cut = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
        for a, b in zip(cut, [*cut[1:], len(blocks)], strict=True):
            paths = path[a:b].to_pylist()
            while a < b:
                same = next((i for i, p in enumerate(paths) if p != paths[0]), len(paths))
                yield (paths[0], size[a].as_py(), int(blocks[a])), value.slice(a, same)
                a, paths = a + same, paths[same:]


class Structure:
    """The bytes of some pieces, each with the brace that ended it, and the signs outside strings if `parity` quotes are open before."""

    def __init__(self, pieces: pa.Array):
        self.raw = ("}".join(pieces.to_pylist()) + "}").encode()
        self.bytes = np.frombuffer(self.raw, np.uint8)
        at = np.arange(len(self.bytes))
        slash = self.bytes == BACKSLASH
        # Backslashes in a row before each byte; an odd number escapes it.
        row = at - np.maximum.accumulate(np.where(slash, -1, at))
        quotes = (self.bytes == QUOTE) & ~np.append(False, (row[:-1] & 1) == 1)
        self.within = np.cumsum(quotes) & 1
        self.parity = int(self.within[-1]) if len(at) else 0
        self.steps = np.isin(self.bytes, OPEN).astype(np.int64) - np.isin(self.bytes, CLOSE)

    def outside(self, parity: int) -> np.ndarray:
        return self.within == parity

    def depths(self, parity: int) -> np.ndarray:
        return np.cumsum(np.where(self.outside(parity), self.steps, 0))


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's parity of quotes and, by the parity before it, change of depth and commas by depth."""
    found: dict[tuple[str, int, int], list] = {}
    for key, pieces in _ranges(batches):
        s, (parity, depth, commas, _) = Structure(pieces), found.setdefault(key, [0, [0, 0], [Counter(), Counter()], None])
        for before in (0, 1):
            depths = s.depths(before ^ parity) + depth[before]
            here = depths[(s.bytes == COMMA) & s.outside(before ^ parity)]
            commas[before].update(dict(zip(*(x.tolist() for x in np.unique(here, return_counts=True)), strict=True)))
            depth[before] = int(depths[-1])
        found[key][0] = parity ^ s.parity
        found[key][3] = found[key][3] or s.raw[:-1].lstrip()[:1].decode("utf-8", "replace") or None
    rows = [{"path": p, "size": z, "block": b, "parity": v[0], "depth": v[1], "commas": [list(c.items()) for c in v[2]], "opens": v[3]} for (p, z, b), v in found.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("parity", pa.int32()), ("depth", pa.list_(pa.int64())), ("commas", pa.list_(pa.map_(pa.int64(), pa.int64()))), ("opens", pa.string())]))


def _starts(ranges: list, opening: str = "[", level: int = 1) -> tuple[dict[tuple[str, int], Start], dict[str, int]]:
    """Where each range of each file that opens so begins, and each file's first number: files by name, one after the other. Records are at depth `level`."""
    opens: dict[str, str] = {}
    for r in sorted(ranges, key=lambda r: (r.path, r.block)):
        if r.opens:
            opens.setdefault(r.path, r.opens)
    ranges = [r for r in ranges if opens.get(r.path) == opening]
    starts, first, number = {}, {}, 0
    for r in sorted(ranges, key=lambda r: (r.path, r.block)):
        if r.path not in first:
            first[r.path], parity, depth, here, member = number, 0, 0, 0, 0
        starts[r.path, r.block] = Start(parity, depth, here, member)
        here += r.commas[parity].get(level - depth, 0)
        member += r.commas[parity].get(1 - depth, 0)
        depth, parity = depth + r.depth[parity], parity ^ r.parity
        number = first[r.path] + here + 1
    return starts, first


def _range_sums(pieces: DataFrame) -> list:
    return pieces.mapInArrow(_summed, "path string, size bigint, block bigint, parity int, depth array<bigint>, commas array<map<bigint,bigint>>, opens string").collect()


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(pos, record): the elements of JSON array files as texts, numbered in the order of the files' names and of the elements.

    Large files are split over tasks. Files without anything, and empty arrays,
    have no records; what isn't an array has none either. The numbers of
    different files leave no gaps but for these.
    """
    pieces = text_pieces(spark, path, "}")
    starts, first = _starts(_range_sums(pieces))
    return _records(pieces, starts, first).select("pos", "record")


def member_records(spark: SparkSession, path: str | list[str], key: str, scalars: tuple[str, ...] = ()) -> DataFrame:
    """(pos, record, *scalars): the elements of the array that a member of an object file is, beside other members as texts (null where there are none).

    As array_records, but that numbers leave gaps; files of anything else, and
    objects without such an array, have no records. Of members of one name the
    first counts. What reaches the driver is also each file's members that are
    neither arrays nor objects.
    """
    pieces = text_pieces(spark, path, "}")
    starts, first = _starts(_range_sums(pieces), "{", 2)

    def outer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for here, some in ((k, v) for k, v in _ranges(batches) if (k[0], k[2]) in starts):
            if here != key:
                key, (parity, depth, _, _) = here, starts[here[0], here[2]]
            s = Structure(some)
            depths = s.depths(parity) + depth
            kept = s.bytes[(depths <= 1) | (s.outside(parity) & (s.steps > 0) & (depths == 2))].tobytes()
            rows.append((here[0], here[2], len(rows), kept))
            parity, depth = parity ^ s.parity, int(depths[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["path", "block", "part", "kept"])

    parts: dict[str, list[bytes]] = {}
    for r in sorted(pieces.mapInArrow(outer, "path string, block bigint, part bigint, kept binary").collect(), key=lambda r: (r.path, r.block, r.part)):
        parts.setdefault(r.path, []).append(bytes(r.kept))
    places, told = {}, []
    # Objects as tuples of pairs, numbers as they are written.
    decoder = json.JSONDecoder(object_pairs_hook=tuple, parse_int=str, parse_float=str, strict=False)
    for name, kept in parts.items():
        members = decoder.raw_decode(b"".join(kept).decode().lstrip("\ufeff \t\r\n"))[0]
        value = lambda k, members=members: next((v for n, v in members if n == k), None)
        if any(isinstance(value(k), (list, tuple)) for k in scalars):
            raise ValueError(f"{name}: one of {', '.join(scalars)} is an array or an object")
        if isinstance(value(key), list):
            places[name] = next(i for i, (n, _) in enumerate(members) if n == key)
        told.append((name, *[v if v is None or isinstance(v, str) else json.dumps(v) for v in map(value, scalars)]))
    named = spark.createDataFrame(told, ", ".join(["_path string", *[f"`{k}` string" for k in scalars]]))
    # A row for each file.
    return _records(pieces, starts, first, 2, places).join(F.broadcast(named), F.col("path") == F.col("_path")).select("pos", "record", *[f"`{k}`" for k in scalars])


def _records(pieces: DataFrame, starts: dict[tuple[str, int], Start], first: dict[str, int], level: int = 1, places: dict[str, int] | None = None) -> DataFrame:
    """(path, pos, record): what commas at depth `level` part; with places, within the member of that number of each object only."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("part", pa.string())])
        key, held, begun = None, [], False

        def done(whole: bool):
            # A byte range may end within a record, never within a character.
            return key[0], first[key[0]] + number, key[2], whole, b"".join(held).decode()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for here, some in ((k, v) for k, v in _ranges(batches) if (k[0], k[2]) in starts and (places is None or k[0] in places)):
            rows = []
            if here != key:
                if held:
                    rows.append(done(False))
                key, held, begun = here, [], False
                parity, depth, number, member = starts[here[0], here[2]]
            s = Structure(some)
            outside, depths = s.outside(parity), s.depths(parity) + depth
            edge = outside & (((s.bytes == COMMA) & (depths == level)) | ((s.steps > 0) & (depths == level)) | ((s.steps < 0) & (depths == level - 1)))
            of = member + np.cumsum(outside & (s.bytes == COMMA) & (depths == 1))
            mine = np.ones(len(of), bool) if places is None else of == places[here[0]]
            at, inside = 0, depth >= level and (places is None or member == places[here[0]])
            for i in np.flatnonzero(edge).tolist():
                if inside:
                    held.append(s.raw[at:i])
                    rows.append(done(begun))
                number += s.bytes[i] == COMMA
                at, held, begun, inside = i + 1, [], True, bool(mine[i]) and s.bytes[i] in (COMMA, OPEN[0])
            if inside:
                held.append(s.raw[at:])
            parity, depth, member = parity ^ s.parity, int(depths[-1]), int(of[-1])
            if rows:
                yield batch(rows)
        if held:
            yield batch([done(False)])

    parts = pieces.mapInArrow(cut, "path string, pos bigint, block bigint, whole boolean, part string")
    joined = parts.where("not whole").groupBy("path", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "").alias("part"))
    every = parts.where("whole").select("path", "pos", "part").unionByName(joined).select("path", "pos", F.regexp_replace("part", "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "").alias("part"))
    return every.where("part <> ''").select("path", "pos", F.to_json(F.parse_json("part")).alias("record"))


def line_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(pos, record): the lines of files that aren't blank; pos ascends in the order of the files' names and of the lines, with gaps.

    A line's pos is the number of bytes before its range, files before it
    included, and its own place in the range: a line has a byte at least.
    """
    lines = text_pieces(spark, path, "\n")
    sizes = lines.select("path", "size").distinct().orderBy("path").collect()
    first = dict(zip((r.path for r in sizes), np.cumsum([0, *(r["size"] + 1 for r in sizes)]).tolist(), strict=False))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for here, some in _ranges(batches):
            key, n = here, n if here == key else 0
            yield pa.RecordBatch.from_arrays([pa.array(first[key[0]] + key[2] + n + np.arange(len(some)), pa.int64()), some], names=["pos", "record"])
            n += len(some)

    return lines.mapInArrow(number, "pos bigint, record string").where(F.trim("record") != "")
