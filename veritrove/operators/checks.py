"""Joins that refuse to drop rows, set comparisons, and validation of settings and requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_join(rows: DataFrame, golds: DataFrame, key: str) -> DataFrame:
    """An equi-join whose probe rows must all have a partner; one without fails at run time and names itself."""
    there = golds.withColumn("_there", F.lit(True))
    joined = rows.join(there, key, "left")
    found = F.coalesce(F.col("_there"), F.raise_error(F.concat(F.lit("no partner for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return joined.where(found).drop("_there")


def filled(rows: DataFrame, lookup: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Columns that are null or empty take the lookup's value."""
    side = lookup.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(side, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.col(f"_{c}").cast("string")))
    return out.drop(*[f"_{c}" for c in columns])


def consistent(judged: DataFrame, scores: DataFrame) -> DataFrame:
    """Judge records against scores of the same (config, id): counts of missing and unscored ones, and of outcomes that differ, which must be 0."""
    s = scores.select("config", F.col("question_id").alias("id"), F.col("outcome").alias("_o"))
    j = judged.join(s, ["config", "id"], "left")
    return j.groupBy("config").agg(
        F.count_if(F.col("_o").isNull()).alias("excluded"), F.count_if(F.col("_o").isNotNull() & F.col("score").isNull()).alias("unscored"),
        F.count_if(F.col("_o").isNotNull() & (F.col("_o") != F.col("outcome"))).alias("mismatches"))


def different_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids that one of two runs lacks or has twice; empty for equal sets."""
    one = lambda d, n: d.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    return one(a, "n_a").join(one(b, "n_b"), key, "full_outer").where("n_a is null or n_b is null or n_a > 1 or n_b > 1")


def subset(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def partitions(counts: list[Column], total: Column) -> Column:
    """Whether counts of parts add up to the whole."""
    return sum(counts[1:], counts[0]) == total


def ready(questions: DataFrame, states: DataFrame, keys: str = "qids") -> DataFrame:
    """Questions with keys, all of which are cached."""
    ok = states.where("state = 'ok'").select(F.col("key").alias("_k"))
    parts = questions.select("question_id", F.explode(keys).alias("_q")).join(ok, F.col("_q") == F.col("_k"), "left")
    return parts.groupBy("question_id").agg(F.bool_and(F.col("_k").isNotNull()).alias("ready")).where("ready").select("question_id")


def deviations(settings: dict, pinned: dict) -> list[str]:
    """Every setting that isn't as pinned, in words."""
    return [f"{k} is {settings.get(k)!r}, pinned {v!r}" for k, v in pinned.items() if settings.get(k) != v]


def sealed_overlap(questions: DataFrame, sealed: DataFrame, key: str = "id") -> int:
    """How many of the questions are of a sealed set."""
    return questions.select(key).distinct().join(sealed.select(key), key, "left_semi").count()


def request_fault(body: object, configs: tuple[str, ...], most_chars: int = 500, most_entities: int = 20) -> str | None:
    """Why a run request can't be taken, or None."""
    if not isinstance(body, dict):
        return "the request must be an object"
    question = body.get("question")
    if not isinstance(question, str) or not question.strip():
        return "question is missing"
    if len(question) > most_chars:
        return f"question is longer than {most_chars} characters"
    if body.get("config") not in configs:
        return "unknown config"
    entities = body.get("entities", [])
    if not isinstance(entities, list) or len(entities) > most_entities:
        return f"entities must be a list of at most {most_entities}"
    for e in entities:
        if not isinstance(e, dict) or not isinstance(e.get("qid"), str) or not re.fullmatch(r"Q[1-9]\d*", e["qid"]):
            return "an entity's key is malformed"
    return None


def captured_settings(settings: dict[str, object], changed_files, outputs: tuple[str, ...] = (), strict: bool = False) -> dict:
    """A run's settings with whether the code was clean. changed_files: a call that gives changed paths, or raises where that can't be told.

    Paths below `outputs` don't count; strict fails where cleanliness isn't known, otherwise it is recorded as None.
    """
    try:
        changed = [p for p in changed_files() if not p.startswith(outputs)]
    except Exception as e:
        if strict:
            raise RuntimeError("whether the code is clean can't be told") from e
        return {**settings, "clean": None, "changed": []}
    return {**settings, "clean": not changed, "changed": sorted(changed)}


def sealed_faults(questions: DataFrame, sealed: DataFrame, spent: bool, clean: bool | None, digest: str, expected: str, key: str = "id") -> list[str]:
    """Why a sealed set may not be run: its questions are in use, its hash differs, it was spent before, or the code isn't clean."""
    faults = {
        "questions of the sealed set are in this run": sealed_overlap(questions, sealed, key) > 0,
        "the sealed set isn't the one that was sealed": digest != expected,
        "the sealed set was run before": spent,
        "the code has changes that aren't committed": clean is not True,
    }
    return [what for what, holds in faults.items() if holds]
