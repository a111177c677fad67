"""Stored query bindings, and the retry policy of the live connector."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_retries(fetch: Callable[[], object], attempts: int = 1, sleep=time.sleep) -> object:
    """The result of a fetch, tried again after 2, 4, ... seconds; the last error is raised."""
    for k in range(1, attempts + 1):
        try:
            return fetch()
        except Exception:
            if k == attempts:
                raise
            sleep(2**k)
    raise ValueError("attempts must be positive")


def stored_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(key, cells): a row for each binding of each JSON file, key being the file's name and cells its plain values by name.

    Files are read by Spark, so they may lie wherever it reads; one that isn't
    a reply of the service fails.
    """
    reply = F.get_json_object("value", "$.results.bindings")
    cells = F.from_json(reply, "array<map<string,struct<value:string>>>")
    bad = F.raise_error(F.concat(F.lit("not a reply: "), F.col("key"))).cast("array<map<string,struct<value:string>>>")
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*)[.]json$", 1).alias("key"), "value")
    return raw.select("key", F.explode(F.when(cells.isNotNull(), cells).otherwise(bad)).alias("row")).select("key", F.transform_values("row", lambda _, v: v["value"]).alias("cells"))
