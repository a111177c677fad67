"""Resampling and exact tests over paired and unpaired values.

The bootstrap reproduces the standard library's seeded draws, so intervals can
be compared number by number. A group's stream is cut into segments; how many
draws each gives is counted in parallel, running sums say which resamples begin
in it, and each segment's task jumps to its place and draws those. No task
needs what another has drawn.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions.text import is_attempted
from .mersenne import Draws

RESAMPLES, SEED, ALPHA = 10_000, 0, 0.05
#: Values of a group: each of its tasks holds all of them.
MOST_VALUES = 50_000_000
#: Outputs of the generator in a segment, and segments of a group.
SEGMENT, SEGMENTS = 1 << 22, 256
INTERVAL = ("delta", "ci_low", "ci_high", "p_value", "significant")


def _too_many(n: Column) -> Column:
    return F.when(n <= MOST_VALUES, n).otherwise(F.raise_error(F.lit("too many values for an exact bootstrap; use poisson_bootstrap")).cast("bigint"))


def _interval(means: Column, observed: Column, alpha: float = ALPHA) -> list[Column]:
    """Columns of INTERVAL from the sorted means of all resamples."""
    b = F.size(means)
    low, high = F.get(means, F.floor(alpha / 2 * b).cast("int")), F.get(means, F.least(F.floor((1 - alpha / 2) * b), b - 1).cast("int"))
    tail = F.least(F.size(F.filter(means, lambda m: m <= 0)), F.size(F.filter(means, lambda m: m >= 0)))
    return [observed.alias("delta"), low.alias("ci_low"), high.alias("ci_high"), F.least(F.lit(1.0), 2 * tail / b).alias("p_value"), ((low > 0) | (high < 0)).alias("significant")]


def resampled(values: np.ndarray, draws: Draws, resamples: int) -> np.ndarray:
    """The means of the next resamples, each summed from left to right."""
    n, out = len(values), []
    rows = max(1, 2_000_000 // n)
    for a in range(0, resamples, rows):
        r = min(rows, resamples - a)
        out.append(np.cumsum(values[draws.below(n, r * n)].reshape(r, n), axis=1)[:, -1] / n)
    return np.concatenate(out) if out else np.zeros(0)


def _drawn(seed: int):
    @F.pandas_udf(ST.LongType())
    def accepted(n: pd.Series, at: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([Draws(seed, int(a)).accepted(int(x), int(k)) for x, a, k in zip(n, at, length, strict=True)], dtype="int64")

    @F.pandas_udf(ST.ArrayType(ST.DoubleType()))
    def means(values: pd.Series, at: pd.Series, skip: pd.Series, resamples: pd.Series) -> pd.Series:
        out = []
        for v, a, k, r in zip(values, at, skip, resamples, strict=True):
            draws = Draws(seed, int(a))
            draws.skip(len(v), int(k))
            out.append(resampled(np.asarray(v), draws, int(r)))
        return pd.Series(out)

    return accepted, means


def _ordered(rows: DataFrame, value: str, order: str, by: tuple[str, ...]) -> DataFrame:
    """(by, n, v): each group's values in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col("_v"))))
    d = rows.select(*by, F.col(value).cast("double").alias("_v"), F.col(order).alias("_o")).where("_v is not null")
    # The count fails before the values meet.
    sizes = d.groupBy(*by).agg(_too_many(F.count(F.lit(1))).alias("n")).where("n > 0").select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "n")
    on = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    return d.groupBy(*by).agg(pairs.alias("p")).join(sizes, on or F.lit(True)).select(*by, "n", F.transform("p", lambda x: x["_v"]).alias("v"))


def bootstrap(deltas: DataFrame, value: str, order: str, by: tuple[str, ...] = (), resamples: int = RESAMPLES, seed: int = SEED, segment: int = SEGMENT) -> DataFrame:
    """Paired bootstrap of the mean of `value`, rows in the order of `order`: n and INTERVAL for each group of `by`.

    The means of all resamples of a group meet at its end, and every segment's
    task has all of the group's values (MOST_VALUES at most); for more rows
    there is poisson_bootstrap. A group without values has no row.
    """
    accepted, means = _drawn(seed)
    groups = _ordered(deltas, value, order, by).withColumn("_g", F.xxhash64(F.lit(0), *by))
    # Outputs that resamples x n draws take, with room for eight deviations; at most SEGMENTS parts.
    total, share = F.col("n") * float(resamples), F.col("n") / F.pow(F.lit(2.0), F.length(F.bin("n")))
    outputs = F.ceil(total / share + 8 * F.sqrt(total) / share + 64)
    cut = groups.select(*by, "n", F.greatest(F.lit(segment), F.ceil(outputs / SEGMENTS)).cast("bigint").alias("_length"), outputs.alias("_outputs"))
    cut = cut.select(*by, "n", "_length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_outputs") / F.col("_length")) - 1)).alias("_s")).withColumn("_at", F.col("_s") * F.col("_length"))
    counted = cut.repartition(*by, "_s").withColumn("_found", accepted("n", "_at", "_length"))
    before = F.coalesce(F.sum("_found").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.ceil(F.col("_before") / F.col("n"))
    begun = counted.withColumn("_before", before).withColumn("_first", first).withColumn("_next", F.least(F.lit(resamples), F.ceil((F.col("_before") + F.col("_found")) / F.col("n")))).where("_next > _first")
    begun = begun.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_at", (F.col("_first") * F.col("n") - F.col("_before")).alias("_skip"), (F.col("_next") - F.col("_first")).alias("_r"))
    on = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    jobs = groups.join(begun, on or F.lit(True)).select(*by, "v", "_at", "_skip", "_r").repartition(*by, "_at")
    parts = jobs.select(*by, F.transform(means("v", "_at", "_skip", "_r"), lambda m: m).alias("_m"))
    all_means = parts.groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list("_m"))).alias("_m")).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_m")
    observed = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    return groups.join(all_means, on or F.lit(True)).select(*by, "n", *_interval(F.col("_m"), observed))


def unpaired_bootstrap(rows: DataFrame, value: str, group: str, order: str, resamples: int = RESAMPLES, seed: int = SEED, block: int = 250) -> DataFrame:
    """Difference of means between rows whose `group` is true and false: n_a, n_b and INTERVAL.

    Both groups draw from one stream in turn, so where a resample begins
    depends on those before it: one task counts through the stream and says
    where each block of resamples begins; the blocks are drawn in parallel.
    """
    d = rows.select(F.col(value).cast("double").alias("v"), F.col(group).cast("boolean").alias("g"), F.col(order).alias("o")).where("v is not null and g is not null")
    both = _ordered(d, "v", "o", ("g",)).groupBy().agg(
        *[F.coalesce(F.first(F.when(F.col("g") == g, F.col("v")), ignorenulls=True), F.array().cast("array<double>")).alias(c) for g, c in ((True, "x"), (False, "y"))])

    @F.pandas_udf(ST.ArrayType(ST.StructType([ST.StructField("at", ST.LongType()), ST.StructField("r", ST.LongType())])))
    def blocks(n_x: pd.Series, n_y: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(n_x, n_y, strict=True):
            draws, begun = Draws(seed), []
            for a in range(0, resamples if x and y else 0, block):
                begun.append({"at": draws.at, "r": min(block, resamples - a)})
                for _ in range(begun[-1]["r"]):
                    draws.skip(int(x), int(x))
                    draws.skip(int(y), int(y))
            out.append(begun)
        return pd.Series(out)

    @F.pandas_udf(ST.ArrayType(ST.DoubleType()))
    def differences(xs: pd.Series, ys: pd.Series, at: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for x, y, a, k in zip(xs, ys, at, r, strict=True):
            draws = Draws(seed, int(a))
            mean = lambda v, draws=draws: math.fsum(v[draws.below(len(v), len(v))]) / len(v)
            out.append(np.array([mean(x) - mean(y) for _ in range(int(k))]))
        return pd.Series(out)

    jobs = both.select("x", "y", F.explode(blocks(F.size("x"), F.size("y"))).alias("b")).select("x", "y", F.col("b.at").alias("at"), F.col("b.r").alias("r")).repartition("at")
    means = jobs.select(differences("x", "y", "at", "r").alias("m")).agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
    average = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    found = both.crossJoin(means).withColumn("_d", average("x") - average("y"))
    some = F.size("m") > 0
    nothing = {"delta": 0.0, "ci_low": 0.0, "ci_high": 0.0, "p_value": 1.0, "significant": False}
    filled = [F.when(some, c).otherwise(F.lit(nothing[n])).alias(n) for n, c in zip(INTERVAL, _interval(F.col("m"), F.col("_d")), strict=True)]
    return found.select(F.size("x").cast("bigint").alias("n_a"), F.size("y").cast("bigint").alias("n_b"), *filled)


#: Discordant pairs up to which the probability is a quotient of integers.
BY_INTEGERS = 2000


def _stirling(n: float) -> float:
    """ln n! less Stirling's approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without cancellation where the two are close."""
    if abs(x - mean) > 0.1 * (x + mean):
        return (x * math.log(x / mean) if x else 0.0) + mean - x
    v = (x - mean) / (x + mean)
    total, power, k = (x - mean) * v, 2 * x * v, 1
    while True:
        power, k = power * v * v, k + 2
        if total + power / k == total:
            return total
        total += power / k


def mcnemar_p(n01: int, n10: int) -> float:
    """Two-sided exact binomial probability of the discordant pairs.

    Few pairs by integers. Of many, the term of the smaller count m is taken by
    its saddle point and those below it by their quotients, of which as many
    matter as the root of n: some milliseconds for 10^8 pairs.
    """
    n, m = n01 + n10, min(n01, n10)
    if n01 == n10:
        return 1.0
    if n <= BY_INTEGERS:
        term, tail = 1, 1
        for k in range(1, m + 1):
            term = term * (n - k + 1) // k
            tail += term
        return min(1.0, (2 * tail) / (1 << n))
    if not m:
        return 2.0 * 0.5**n
    log_term = _stirling(n) - _stirling(m) - _stirling(n - m) - _deviance(m, n / 2) - _deviance(n - m, n / 2) + 0.5 * math.log(n / (2 * math.pi * m * (n - m)))
    total, last, i = 1.0, 1.0, 0
    while last > 1e-18 * total and i < m:
        below = np.arange(i, min(m, i + 65_536), dtype=float)
        terms = last * np.cumprod((m - below) / (n - m + 1 + below))
        total, last, i = total + math.fsum(terms), float(terms[-1]), i + len(below)
    return min(1.0, 2 * math.exp(log_term) * total)


def poisson_bootstrap(deltas: DataFrame, value: str, key: str, resamples: int = 200, seed: int = SEED) -> DataFrame:
    """The same interval for any number of rows: each row counts Poisson(1) times in each resample, by a hash of its key.

    Only sums leave the map side, a row for each resample.
    """
    u = F.shiftrightunsigned(F.xxhash64(key, F.col("r"), F.lit(seed)), 11) / float(1 << 53)
    steps, total = F.lit(0), 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps = steps + (u > total).cast("int")
    rows = deltas.select(F.col(key), F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    means = rows.select("r", "v", steps.alias("w")).groupBy("r").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w").cast("double")).alias("m"))
    at = lambda q: F.get(F.array_sort(F.collect_list("m")), F.lit(min(int(q * resamples), resamples - 1)))
    ci = means.agg(at(ALPHA / 2).alias("ci_low"), at(1 - ALPHA / 2).alias("ci_high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p_value"))
    return deltas.agg(F.count(value).alias("n"), F.avg(value).alias("delta")).crossJoin(F.broadcast(ci)).withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


@F.pandas_udf(ST.DoubleType())
def _mcnemar(n01: pd.Series, n10: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(a), int(b)) for a, b in zip(n01, n10, strict=True)])


def mcnemar(pairs: DataFrame, a: Column, b: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact McNemar test of two binary columns of paired rows; anything but 0 and 1 fails."""
    binary = lambda c: F.when(c.cast("double").isin(0.0, 1.0), c.cast("double")).otherwise(F.raise_error(F.lit("mcnemar needs binary values")))
    d = pairs.select(*by, binary(a).alias("_a"), binary(b).alias("_b"))
    counts = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("_a") < F.col("_b")).alias("n01"), F.count_if(F.col("_a") > F.col("_b")).alias("n10"))
    return counts.withColumn("delta", F.coalesce(F.try_divide((F.col("n10") - F.col("n01")).cast("double"), F.col("n_pairs")), F.lit(0.0))).withColumn("p_value", _mcnemar("n01", "n10"))


def deltas(scores: DataFrame, a: str, b: str, value: Column) -> DataFrame:
    """(question_id, delta) of a value between two configs, where both have the question."""
    side = lambda c, n: scores.where(F.col("config") == c).select("question_id", value.cast("double").alias(n))
    return side(a, "_a").join(side(b, "_b"), "question_id").select("question_id", (F.col("_a") - F.col("_b")).alias("delta"))


def compare_configs(scores: DataFrame, a: str, b: str, value: Column, resamples: int = RESAMPLES) -> DataFrame:
    return bootstrap(deltas(scores, a, b, value), "delta", "question_id", resamples=resamples)


def threshold_sweep(scores: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Attempted answers classified at each threshold: (config, threshold, n, correct, hallucination, rank by hallucination)."""
    t = scores.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    out = t.where(is_attempted("outcome")).groupBy("config", "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw_score") >= F.col("threshold")).alias("correct"), F.count_if(F.col("raw_score") < F.col("threshold")).alias("hallucination"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("threshold").orderBy(F.col("hallucination") / F.col("n"), "config")))


def vs_baseline(scores: DataFrame, baseline: str, outcome: str) -> DataFrame:
    """Each other config's exact test against a baseline on one outcome, in one pass."""
    hit = (F.col("outcome") == outcome).cast("int")
    base = scores.where(F.col("config") == baseline).select("question_id", hit.alias("_base"))
    return mcnemar(scores.where(F.col("config") != baseline).select("question_id", "config", hit.alias("_own")).join(base, "question_id"), F.col("_own"), F.col("_base"), ("config",))


def within_attempted(scores: DataFrame, config: str, baseline: str, value: str) -> DataFrame:
    """The baseline's mean where the config attempted, and where it didn't."""
    tried = scores.where((F.col("config") == config) & is_attempted("outcome")).select("question_id")
    base = scores.where(F.col("config") == baseline)
    inside = base.join(tried, "question_id", "left_semi").agg(F.count(F.lit(1)).alias("n_attempted"), F.avg(value).alias("base_on_attempted"))
    return inside.crossJoin(base.join(tried, "question_id", "left_anti").agg(F.count(F.lit(1)).alias("n_rest"), F.avg(value).alias("base_on_rest")))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """n rows in equal shares of each stratum, what is left over going to the largest; by a hash of key and seed."""
    if exclude is not None:
        rows = rows.join(exclude.select(key), key, "left_anti")
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    quota = sizes.withColumn("_k", F.count(F.lit(1)).over(everything)).withColumn("_r", F.row_number().over(everything.orderBy(F.desc("_n"), stratum)))
    quota = quota.select(stratum, (F.floor(F.lit(n) / F.col("_k")) + (F.col("_r") <= n % F.col("_k")).cast("int")).alias("_q"))
    by_hash = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("_rn", F.row_number().over(by_hash)).join(F.broadcast(quota), stratum).where("_rn <= _q").drop("_rn", "_q")


def round_robin(rows: DataFrame, bucket: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, one of each bucket in turn; within a bucket by a hash of key and seed. Adds turn."""
    by_hash = Window.partitionBy(bucket).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("turn", F.row_number().over(by_hash)).orderBy("turn", bucket).limit(n)
