"""Report sections: tests of every config against a baseline, on the questions that a section is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HALLUCINATION, is_attempted
from .stats import RESAMPLES, bootstrap, mcnemar

LEAST_N = 50


def _against(scores: DataFrame, baseline: str) -> DataFrame:
    """Rows of the other configs beside the baseline's row of the same question."""
    wrong = (F.col("outcome") == HALLUCINATION).cast("int")
    base = scores.where(F.col("config") == baseline).select("question_id", F.col("f1").alias("base_f1"), wrong.alias("base_wrong"))
    return scores.where(F.col("config") != baseline).withColumn("wrong", wrong).join(base, "question_id")


def _tested(rows: DataFrame, by: tuple[str, ...], value: str, resamples: int) -> DataFrame:
    """Bootstrap interval of the mean of `value` and exact test of wrong against base_wrong, for each group."""
    interval = bootstrap(rows, value, "question_id", by, resamples).withColumnRenamed("p_value", "bootstrap_p")
    exact = mcnemar(rows, F.col("wrong"), F.col("base_wrong"), by).select(*[F.col(c).alias(f"_{c}") for c in by], "n01", "n10", F.col("p_value").alias("mcnemar_p"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return interval.join(exact, on).drop(*[f"_{c}" for c in by])


def baseline_section(scores: DataFrame, baseline: str, resamples: int = RESAMPLES) -> DataFrame:
    """Each config's difference in hallucination rate to the baseline, with interval and exact test."""
    rows = _against(scores, baseline).withColumn("_d", F.col("wrong") - F.col("base_wrong"))
    return _tested(rows, ("config",), "_d", resamples)


def attempted_section(scores: DataFrame, baseline: str, resamples: int = RESAMPLES) -> DataFrame:
    """F1 of each config and the baseline where the config attempted, the difference with its interval, and the baseline's F1 elsewhere."""
    rows = _against(scores, baseline).withColumn("_in", is_attempted("outcome"))
    inside = rows.where("_in").withColumn("_d", F.col("f1") - F.col("base_f1"))
    means = rows.groupBy(F.col("config").alias("_c")).agg(
        F.avg(F.when(F.col("_in"), F.col("f1"))).alias("config_f1"), F.avg(F.when(F.col("_in"), F.col("base_f1"))).alias("base_f1"), F.avg(F.when(~F.col("_in"), F.col("base_f1"))).alias("base_f1_rest"))
    return bootstrap(inside, "_d", "question_id", ("config",), resamples).withColumnRenamed("p_value", "bootstrap_p").join(means, F.col("config") == F.col("_c")).drop("_c")


def joint_section(scores: DataFrame, pairs: list[tuple[str, str]], resamples: int = RESAMPLES) -> DataFrame:
    """For each pair of configs, where both attempted: mean F1 of each, the difference with its interval, and the exact test of hallucinations."""
    names = scores.sparkSession.createDataFrame(pairs, "a string, b string")
    side = scores.where(is_attempted("outcome")).select("question_id", "config", "f1", (F.col("outcome") == HALLUCINATION).cast("int").alias("wrong"))
    a = side.select("question_id", F.col("config").alias("a"), F.col("f1").alias("f1_a"), "wrong").join(F.broadcast(names), "a")
    b = side.select("question_id", F.col("config").alias("b"), F.col("f1").alias("f1_b"), F.col("wrong").alias("base_wrong"))
    rows = a.join(b, ["question_id", "b"]).withColumn("_d", F.col("f1_a") - F.col("f1_b"))
    means = rows.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.avg("f1_a").alias("f1_a"), F.avg("f1_b").alias("f1_b"))
    return _tested(rows, ("a", "b"), "_d", resamples).join(means, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).drop("_a", "_b")


def claim_checks(scores: DataFrame, baseline: str, group: str, resamples: int = RESAMPLES, least_n: int = LEAST_N) -> DataFrame:
    """The baseline section within each group of questions that has at least `least_n`; rows without a group are left out."""
    rows = _against(scores, baseline).where(F.col(group).isNotNull()).withColumn("_d", F.col("wrong") - F.col("base_wrong"))
    sizes = rows.groupBy(F.col("config").alias("_c"), F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_n)
    large = rows.join(sizes, (F.col("config") == F.col("_c")) & (F.col(group) == F.col("_g")), "left_semi")
    return _tested(large, ("config", group), "_d", resamples)
