"""A keyed cache as a log of entry versions: upserts keep all other entries, whoever else is writing.

A write puts its rows, partitioned by a hash of the key, into a folder of its
own and then names that folder in a file of the log, which appears at once
(written aside, then renamed). Nothing is ever overwritten, so a reader sees
all of a write or nothing of it, and two writers can't lose each other's
entries. Every row has a version, one above those that its writer saw, and the
writer's name; of a key the row of the greatest (version, writer) holds. A
removal is a row that says so. compact() merges the rows of several writes,
their versions kept, into one folder that replaces theirs in the log; merging
again, or while others write, changes nothing. Replaced and abandoned folders
stay for readers that are under way until vacuum().

A lookup of given keys reads only their buckets (partition pruning) and, as
files are sorted by key and have Bloom filters of it, few of their row groups.

    path/log/WRITER.json              {"version", "replaces", "buckets", "schema", "key"}
    path/data/write=WRITER/bucket=B/*.parquet
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a stored row beside the entry's own.
VERSION, WRITER, GONE, BUCKET = "_version", "_writer", "_gone", "bucket"
#: Keys of a lookup that are compared by value in the scan; more are joined.
LISTED = 1000


class Write(NamedTuple):
    """A file of the log."""

    writer: str
    version: int
    replaces: list[str]
    buckets: int
    schema: str
    key: str


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _list(spark: SparkSession, path: str) -> list:
    p, fs = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole or not at all: written beside its place, then renamed over what is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = path.rpartition("/")
    aside, fs = _fs(spark, f"{at[0]}/.{at[2]}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(hadoop, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(aside), fs.makeQualified(_fs(spark, path)[0]), options)
    except BaseException:
        out.close()
        fs.delete(aside, False)
        raise


def writes(spark: SparkSession, path: str) -> list[Write]:
    """The writes that hold, oldest first: those of the log that no other replaces."""
    names = [f.getPath().getName() for f in _list(spark, f"{path}/log")]
    files = [f"{path}/log/{n}" for n in names if n.endswith(".json") and not n.startswith(".")]
    if not files:
        return []
    lines = spark.read.text(files, wholetext=True).collect()
    found = [Write(**json.loads(r.value)) for r in lines]
    replaced = {w for x in found for w in x.replaces}
    return sorted((w for w in found if w.writer not in replaced), key=lambda w: (w.version, w.writer))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _append(rows: DataFrame, path: str, key: str, buckets: int, version: int, writer: str, replaces: Iterable[str]) -> str:
    """Writes rows that have VERSION, WRITER and GONE, then the log's file for them."""
    spark = rows.sparkSession
    dealt = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, key)
    dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy(BUCKET).parquet(f"{path}/data/write={writer}")
    put_text(spark, f"{path}/log/{writer}.json", json.dumps(Write(writer, version, list(replaces), buckets, rows.schema.json(), key)._asdict()))
    return writer


def _versioned(rows: DataFrame, path: str, key: str, buckets: int, gone: bool) -> str:
    held, writer = writes(rows.sparkSession, path), uuid.uuid4().hex
    if held and (held[-1].key, held[-1].buckets) != (key, buckets or held[-1].buckets):
        raise ValueError(f"the cache has {held[-1].buckets} buckets by {held[-1].key}")
    buckets, version = held[-1].buckets if held else buckets or 64, 1 + max((w.version for w in held), default=0)
    bad = F.raise_error(F.lit("an entry without a key")).cast(rows.schema[key].dataType)
    named = rows.withColumn(key, F.when(F.col(key).isNotNull(), F.col(key)).otherwise(bad))
    return _append(named.withColumns({VERSION: F.lit(version).cast("bigint"), WRITER: F.lit(writer), GONE: F.lit(gone)}), path, key, buckets, version, writer, ())


def upsert(entries: DataFrame, path: str, key: str, buckets: int | None = None, order: str | None = None) -> str:
    """Adds entries or puts them in the place of those of their keys; all others stay. Returns the write's name.

    Of several entries of one key in one write the greatest by `order` holds,
    any one without it; an entry without a key fails. The number of buckets is
    the first write's (64 by default).
    """
    if order:
        entries = entries.groupBy(key).agg(F.max_by(F.struct(*[c for c in entries.columns if c != key]), order).alias("_e")).select(key, "_e.*")
    else:
        entries = entries.dropDuplicates([key])
    return _versioned(entries, path, key, buckets or 0, False)


def remove(keys: DataFrame, path: str, key: str) -> str:
    """Removes the entries of keys; keys without one are no error."""
    return _versioned(keys.select(key).distinct(), path, key, 0, True)


def _stored(spark: SparkSession, path: str, held: list[Write], where: list[Column] = ()) -> DataFrame:
    """All rows of the writes, with the columns of the newest one that isn't a removal."""
    fields: dict[str, T.StructField] = {}
    for w in held:
        fields |= {f.name: f for f in T.StructType.fromJson(json.loads(w.schema)).fields}
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()] + [T.StructField(BUCKET, T.IntegerType()), T.StructField("write", T.StringType())])
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/write={w.writer}" for w in held]).drop("write")
    for condition in where:
        rows = rows.where(condition)
    return rows


def _last(rows: DataFrame, key: str) -> DataFrame:
    """Each key's row of the greatest (version, writer)."""
    rest = [c for c in rows.columns if c not in (key, BUCKET)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(VERSION, WRITER)).alias("_e")).select(key, "_e.*")


def entries(spark: SparkSession, path: str, keys: DataFrame | Iterable | None = None) -> DataFrame:
    """The cache's entries, or those of given keys (a list of values, or a table with a column of the key's name).

    A table's keys narrow the scan to their buckets, of which there is a fixed
    number, and are joined; a list goes into the scan's filters itself.
    """
    held = writes(spark, path)
    if not held:
        raise LookupError(f"no cache at {path}")
    key, buckets = held[-1].key, held[-1].buckets
    if keys is None:
        rows = _stored(spark, path, held)
    elif isinstance(keys, DataFrame):
        wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
        there = [r[0] for r in wanted.select(bucket_of(F.col(key), buckets)).distinct().collect()]
        rows = _stored(spark, path, held, [F.col(BUCKET).isin(there)]).join(wanted, key, "left_semi")
    else:
        values = list(keys)
        if len(values) > LISTED:
            kind = T.StructType([T.StructField(key, T.StructType.fromJson(json.loads(held[-1].schema))[key].dataType)])
            return entries(spark, path, spark.createDataFrame([(v,) for v in values], kind))
        there = [r[0] for r in spark.createDataFrame([(str(v),) for v in values], "v string").select(bucket_of(F.col("v"), buckets)).distinct().collect()]
        rows = _stored(spark, path, held, [F.col(BUCKET).isin(there), F.col(key).isin(values)])
    return _last(rows, key).where(~F.col(GONE)).drop(VERSION, WRITER, GONE)


def compact(spark: SparkSession, path: str) -> str | None:
    """One folder in the place of all that the log names now. Versions and removals are kept, so that merging with later or other writes gives the same."""
    held = writes(spark, path)
    if len(held) < 2:
        return None
    last = held[-1]
    return _append(_last(_stored(spark, path, held), last.key), path, last.key, last.buckets, last.version, uuid.uuid4().hex, [w.writer for w in held])


def vacuum(spark: SparkSession, path: str, hours: float = 24.0) -> int:
    """Deletes folders that the log doesn't name and log files that are replaced, if older than some hours; returns how many."""
    before, n = (time.time() - 3600 * hours) * 1000, 0
    # The log first and its oldest files before others: what a file replaces never holds again, and no named folder is gone.
    for folder in ("log", "data"):
        p, fs = _fs(spark, f"{path}/{folder}")
        named = {w.writer for w in writes(spark, path)}
        if folder == "data":
            named |= {f.getPath().getName().removesuffix(".json") for f in _list(spark, f"{path}/log")}
        for f in sorted(_list(spark, f"{path}/{folder}"), key=lambda f: f.getModificationTime()):
            if f.getPath().getName().removeprefix("write=").removesuffix(".json") not in named and f.getModificationTime() < before:
                n += bool(fs.delete(f.getPath(), True))
    return n


def states(spark: SparkSession, path: str, keys: DataFrame, state: Column) -> DataFrame:
    """(key, state) of every wanted key: what `state` makes of its entry, or missing."""
    found = entries(spark, path, keys)
    key = next(c for c in keys.columns if c in found.columns)
    return keys.select(key).distinct().join(found.select(key, state.alias("_s")), key, "left").select(key, F.coalesce("_s", F.lit("missing")).alias("state"))
