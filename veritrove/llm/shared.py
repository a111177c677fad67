"""Places and small plan helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .words import text_bytes

#: Bytes of text that one task of a keyed exchange should get.
TASK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "veritrove-shared")
    return f"{base.rstrip('/')}/veritrove-{uuid.uuid4().hex}"


#: Has Spark delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, a lost executor loses nothing.

    The shuffle files that made it are of no more use and go at once.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{name}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, bytes of a text column), one aggregation."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


#: Bytes of text that a Python worker handles at once; its arrays are some 20 times this.
SLICE_BYTES = 4 << 20


def sliced(offsets: np.ndarray, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Row ranges of a batch, each of about `most` bytes or of one row."""
    cuts, n = [0], len(offsets) - 1
    while cuts[-1] < n:
        to = int(np.searchsorted(offsets, offsets[cuts[-1]] + most, "right")) - 1
        cuts.append(min(n, max(cuts[-1] + 1, to)))
    return list(pairwise(cuts))


def annotate(df: DataFrame, text_column: str, keep: list[str], make, fields: str) -> DataFrame:
    """Columns computed from the text, row by row, in Arrow batches and without a shuffle.

    make() is called once in each task and gives f(texts: pa.Array) -> list of
    arrays as `fields` (DDL) has them. Returns columns row (struct of `keep`)
    and found (struct of fields), so that no name can clash.
    """
    names = list(dict.fromkeys([*keep, text_column]))
    out = T.StructType([T.StructField("row", df.select(*keep).schema), T.StructField("found", T.StructType.fromDDL(fields))])
    at, kept = names.index(text_column), [names.index(c) for c in keep]
    found = out["found"].dataType
    arrow_type = to_arrow_schema(found)

    def run(batches):
        f = make()
        for batch in batches:
            row = batch.column(0)
            off, _ = text_bytes(row.field(at))
            for a, b in sliced(off):
                part = row.slice(a, b - a)
                fields_of = part.flatten()
                made = [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(f(fields_of[at]), arrow_type.types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.StructArray.from_arrays([fields_of[j] for j in kept], list(keep)), pa.StructArray.from_arrays(made, arrow_type.names)],
                    names=["row", "found"],
                )

    return df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).mapInArrow(run, out)
