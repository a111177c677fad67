"""Aggregation and comparison over the long score table.

Score tables have a row for each (question_id, config), with outcome, em, f1
and score. Rates over nothing are null; the two means over attempts alone are
0 there, as reports expect.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ABSTENTION, CORRECT, HALLUCINATION, OTHER, OUTCOMES, is_attempted
from .digest import joined_digests

SMALL = 50


def rate(condition: Column, of: Column | None = None) -> Column:
    """Share of rows, or of rows where `of` holds; null over nothing."""
    if of is None:
        return F.avg(condition.cast("double"))
    return F.avg(F.when(of, condition.cast("double")))


def outcome_columns() -> list[Column]:
    """Counts, rates and means of a group of score rows."""
    o, att = F.col("outcome"), is_attempted("outcome")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(att).alias("n_attempted"),
        *[F.count_if(o == x).alias(f"n_{x}") for x in OUTCOMES],
        rate(o == ABSTENTION).alias("abstention_rate"), rate(att).alias("coverage"),
        rate(o == CORRECT).alias("correct_rate"), rate(o == HALLUCINATION).alias("hallucination_rate"), rate(o == OTHER).alias("other_rate"),
        F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.avg("score").alias("score"),
        F.coalesce(F.avg(F.when(att, F.col("em"))), F.lit(0.0)).alias("em_attempted"),
        F.coalesce(F.avg(F.when(att, F.col("f1"))), F.lit(0.0)).alias("f1_attempted"),
        rate(o == CORRECT, att).alias("correct_rate_attempted"), rate(o == HALLUCINATION, att).alias("hallucination_rate_attempted"),
    ]


def checked(scores: DataFrame) -> DataFrame:
    """Fails at run time on an outcome outside the four, which would leak out of every rate."""
    ok = F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))
    return scores.withColumn("outcome", F.when(ok, F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce("outcome", F.lit("null"))))))


def outcomes(scores: DataFrame, by: tuple[str, ...] = ("config",)) -> DataFrame:
    extra = [F.avg("context_words").alias("context_words")] if "context_words" in scores.columns else []
    return checked(scores).groupBy(*by).agg(*outcome_columns(), *extra)


def stratified(scores: DataFrame, axes: tuple[str, ...] = ("complexity", "answer_type")) -> DataFrame:
    """Outcomes per config, and per config and each axis, in one pass of grouping sets: columns config, axis, value."""
    sets = [[F.col("config")], *[[F.col("config"), F.col(a)] for a in axes]]
    grouped = checked(scores).groupingSets(sets, F.col("config"), *[F.col(a) for a in axes]).agg(F.grouping_id().alias("_g"), *outcome_columns())
    bits = {a: 1 << (len(axes) - 1 - i) for i, a in enumerate(axes)}
    all_bits = sum(bits.values())
    axis, value = F.lit("all"), F.lit(None).cast("string")
    for a, bit in bits.items():
        here = F.col("_g") == all_bits - bit
        axis, value = F.when(here, F.lit(a)).otherwise(axis), F.when(here, F.col(a).cast("string")).otherwise(value)
    return grouped.withColumn("axis", axis).withColumn("value", value).drop("_g", *axes)


def over_vocabulary(scores: DataFrame, vocabulary: DataFrame, axis: str) -> DataFrame:
    """Outcomes for every value of a closed vocabulary, empty groups included; their rates are null."""
    v = vocabulary.select(F.col(axis).alias("_v"), *[c for c in vocabulary.columns if c != axis])
    found = outcomes(scores, (axis,))
    joined = v.join(found, F.col("_v") == F.col(axis), "left").drop(axis).withColumnRenamed("_v", axis)
    counts = [c for c in joined.columns if c == "n" or c.startswith("n_")]
    return joined.na.fill(0, counts)


def faithfulness_summary(judged: DataFrame, by: tuple[str, ...] = ("config",)) -> DataFrame:
    """Over attempts: how many could be scored, why not the others, and the mean of those that could."""
    att, has = is_attempted("outcome"), F.col("score").isNotNull()
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_ids"), F.count_if(att).alias("n_attempted"), F.count_if(att & has).alias("n_scoreable"),
        F.count_if(att & ~has).alias("n_unscored_attempts"), F.avg(F.when(att, F.col("score"))).alias("mean"),
        F.avg(F.when(F.col("outcome") == CORRECT, F.col("score"))).alias("mean_correct"), F.avg(F.when(F.col("outcome") == HALLUCINATION, F.col("score"))).alias("mean_wrong"),
        rate(att & has).alias("share_of_ids"), rate(has, att).alias("share_of_attempts"),
    )


def unscored_reasons(judged: DataFrame, by: tuple[str, ...] = ("config",)) -> DataFrame:
    return judged.where(is_attempted("outcome") & F.col("score").isNull()).groupBy(*by, F.coalesce("status", F.lit("unknown")).alias("status")).count()


def paired(scores: DataFrame, a: str, b: str, columns: tuple[str, ...] = ("outcome", "f1")) -> DataFrame:
    """The two configs' rows of each question that both have: question_id, a_*, b_*."""
    side = lambda c, p: scores.where(F.col("config") == c).select("question_id", *[F.col(x).alias(f"{p}_{x}") for x in columns])
    return side(a, "a").join(side(b, "b"), "question_id")


def n_dropped(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Questions that only one of two configs has."""
    side = lambda c, n: scores.where(F.col("config") == c).select("question_id", F.lit(True).alias(n))
    both = side(a, "_a").join(side(b, "_b"), "question_id", "full_outer")
    return both.agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_dropped"))


def pair_full(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Differences of rates and F1 of two configs over their common questions."""
    p = paired(scores, a, b)
    delta = lambda o: (rate(F.col("a_outcome") == o) - rate(F.col("b_outcome") == o)).alias(f"delta_{o}")
    return p.agg(F.count(F.lit(1)).alias("n"), *[delta(o) for o in (HALLUCINATION, CORRECT, ABSTENTION)], (F.avg("a_f1") - F.avg("b_f1")).alias("delta_f1"))


def pair_attempted(scores: DataFrame, a: str, b: str) -> DataFrame:
    """The same where both attempted, with the 2 x 2 table of hallucinations and the share retained."""
    p = paired(scores, a, b)
    both = is_attempted("a_outcome") & is_attempted("b_outcome")
    ha, hb = F.col("a_outcome") == HALLUCINATION, F.col("b_outcome") == HALLUCINATION
    return p.agg(
        F.count(F.lit(1)).alias("denominator_n"), F.count_if(both).alias("n_common"), rate(both).alias("retained_share"),
        F.count_if(both & ha & hb).alias("both_hallucinate"), F.count_if(both & ha & ~hb).alias("a_only"), F.count_if(both & ~ha & hb).alias("b_only"), F.count_if(both & ~ha & ~hb).alias("neither"),
        (rate(ha, both) - rate(hb, both)).alias("delta_hallucination"), (F.avg(F.when(both, F.col("a_f1"))) - F.avg(F.when(both, F.col("b_f1")))).alias("delta_f1"),
    )


def pair_faithfulness(judged: DataFrame, a: str, b: str) -> DataFrame:
    """Means and difference of judge scores where both configs attempted and have one."""
    side = lambda c, n: judged.where((F.col("config") == c) & is_attempted("outcome") & F.col("score").isNotNull()).select("question_id", F.col("score").alias(n))
    return side(a, "a").join(side(b, "b"), "question_id").agg(
        F.count(F.lit(1)).alias("n_common_scoreable"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), (F.avg("a") - F.avg("b")).alias("delta"))


def cohorts(scores: DataFrame, judged: DataFrame | None = None, configs: tuple[str, ...] = ()) -> DataFrame:
    """(cohort, question_id): full, each config's attempts, and the attempts common to each pair and to all; the same for scoreable ones."""
    flags = scores.groupBy("question_id").agg(*[F.coalesce(F.bool_or(F.when(F.col("config") == c, is_attempted("outcome"))), F.lit(False)).alias(f"att_{i}") for i, c in enumerate(configs)])
    named = [(F.lit(True), "full")]

    def sets(prefix: str, own: str, common: str, order):
        for i in order:
            named.append((F.col(f"{prefix}_{i}"), f"{own}:{configs[i]}"))
        for i, j in combinations(order, 2):
            named.append((F.col(f"{prefix}_{i}") & F.col(f"{prefix}_{j}"), f"{common}:{configs[i]}+{configs[j]}"))
        everyone = F.lit(True)
        for i in order:
            everyone = everyone & F.col(f"{prefix}_{i}")
        named.append((everyone, f"{common}:all"))

    sets("att", "own_attempted", "common_attempted", range(len(configs)))
    if judged is not None:
        more = judged.groupBy("question_id").agg(*[
            F.coalesce(F.bool_or(F.when((F.col("config") == c) & is_attempted("outcome"), F.col("score").isNotNull())), F.lit(False)).alias(f"sc_{i}") for i, c in enumerate(configs)])
        flags = flags.join(more, "question_id", "left").na.fill(False)
        sets("sc", "own_scoreable", "common_scoreable", range(len(configs)))
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in named]), lambda x: x.isNotNull())
    return flags.select(F.explode(names).alias("cohort"), "question_id")


def membership_hash(rows: DataFrame, by: str, item: str) -> DataFrame:
    """Count and SHA-256 of the newline-joined sorted distinct members of each group, of any size: see joined_digests."""
    distinct = rows.select(by, F.col(item).cast("string").alias("_m")).where("_m is not null").distinct()
    return joined_digests(distinct, [by], "_m", separator="\n").select(by, "n", F.col("sha256").alias("members_sha256"))


def transitions(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Outcome of b by outcome of a, zeros filled, with each cell's share of its row of b (null where the row is empty)."""
    grid = scores.sparkSession.createDataFrame([(x, y) for x in OUTCOMES for y in OUTCOMES], "b_outcome string, a_outcome string")
    found = paired(scores, a, b).groupBy("b_outcome", "a_outcome").count()
    full = grid.join(found, ["b_outcome", "a_outcome"], "left").na.fill(0, ["count"])
    return full.withColumn("share", F.try_divide(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy("b_outcome"))))


def attempt_patterns(scores: DataFrame) -> DataFrame:
    """How many questions each combination of configs attempted; 'none' where none did."""
    per = scores.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(is_attempted("outcome"), F.col("config")))), "+").alias("p"))
    return per.groupBy(F.when(F.col("p") == "", "none").otherwise(F.col("p")).alias("pattern")).agg(F.count(F.lit(1)).alias("n_questions"))


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


#: Ranks around the middle that a sketch of accuracy 10,000 may be off, as a share of all, with room.
_OFF = 2.5e-4


def exact_median(rows: DataFrame, by: list[str], value: str, name: str = "median", upper: bool = False) -> DataFrame:
    """(by, name): the exact median of each group, or the element at half of the sorted values, rounded up; null over nothing.

    A mergeable sketch brackets the middle; a second pass counts what lies
    below the bracket and the different values in it, of which there are few
    (some 5 in 10,000 of a group's rows). No task holds a group's values, and
    only counts are shuffled. A bracket that misses the middle is an error.
    """
    keys = [f"_{i}" for i in range(len(by))]
    v = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("_v"))
    near = F.percentile_approx("_v", [0.5 - _OFF, 0.5 + _OFF], 10_000)
    middle = v.groupBy(*keys).agg(F.count("_v").alias("_n"), near.alias("_near")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_n", F.col("_near")[0].alias("_low"), F.col("_near")[1].alias("_high"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    inside = v.join(middle, same or F.lit(True)).where("_v <= _high").groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    counted = inside.withColumn("_to", up_to)
    at = lambda place: F.max(F.when((place >= F.col("_to") - F.col("_c")) & (place < F.col("_to")), F.struct(F.col("_v").alias("v"))))
    first, second = (F.floor(F.col("_n") / 2),) * 2 if upper else (F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    found = counted.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(at(first).alias("_a"), at(second).alias("_b"))
    missed = F.raise_error(F.lit("the sketch missed a median")).cast(rows.schema[value].dataType)
    whole = lambda c: F.when(F.col(f"{c}.v").isNotNull(), F.col(f"{c}.v")).otherwise(missed)
    value_of = whole("_a") if upper else (whole("_a") + (whole("_b") - whole("_a")) * F.lit(0.5)).cast("double")
    groups = v.groupBy(*keys).agg(F.lit(1).alias("_one"))
    # Groups without values aren't among those found.
    return groups.join(found.withColumn("_there", F.lit(True)), same or F.lit(True), "left").select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.when(F.col("_there"), value_of).alias(name))


def _with(base: DataFrame, by: list[str], more: DataFrame) -> DataFrame:
    """base with the other columns of a table of the same groups."""
    named = more.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], *[c for c in more.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    return base.join(named, same or F.lit(True), "left").drop(*[f"_{i}" for i in range(len(by))])


def context_sizes(rows: DataFrame, by: str, words: str) -> DataFrame:
    """n, mean to one decimal, exact median, least and most of measured sizes."""
    m = rows.where(F.col(words).isNotNull())
    base = m.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(words), 1).alias("mean"), F.min(words).alias("least"), F.max(words).alias("most"))
    return _with(base, [by], exact_median(m, [by], words)).select(by, "n", "mean", "median", "least", "most")


def condense_stats(rows: DataFrame, by: str) -> DataFrame:
    """Of instrumented rows: fallbacks, empty pools, and the upper median of condensed words."""
    base = rows.groupBy(by).agg(
        F.count_if(F.col("condense_fallback").isNotNull()).alias("n_instrumented"), F.count_if("condense_fallback").alias("n_fallback"), F.count_if(F.col("pool_size") == 0).alias("n_empty_pool"))
    return _with(base, [by], exact_median(rows, [by], "condense_words", "median_words", upper=True))


def arm_summary(rows: DataFrame, by: str) -> DataFrame:
    """Counts and percentages of an arm; partition says whether the four outcomes add up to it."""
    graded = ~F.col("failed")
    parts = [F.count_if(graded & (F.col("outcome") == o)) for o in OUTCOMES]
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("failed").alias("errors"), F.count_if(graded).alias("graded"),
        *[(100 * rate(F.col("outcome") == o, graded)).alias(f"pct_{o}") for o in OUTCOMES],
        F.count_if(graded & (F.col("finish_reason") == "length")).alias("truncated"),
        (sum(parts[1:], parts[0]) == F.count_if(graded)).alias("partition"))


def presence_by_outcome(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Gold presence in contexts by outcome; undefined presence (null) is left out."""
    d = rows.where(F.col("present").isNotNull())
    return d.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("eligible"), F.count_if("present").alias("detected"), F.percentile("context_words", 0.5).alias("median_words"))


def context_noise(contexts: DataFrame, id_column: str, context_column: str) -> DataFrame:
    """Per context: parsed lines, lines whose subject is their value, and repeats beyond the first."""
    from ..functions.text import parse_line, strip

    lines = contexts.select(id_column, F.explode(F.split(context_column, "\n")).alias("l")).select(id_column, strip(F.regexp_replace("l", "^\\s*- ", "")).alias("l"))
    p = lines.withColumn("p", parse_line("l")).where(F.col("p").isNotNull()).groupBy(id_column, "l").agg(F.count(F.lit(1)).alias("c"), F.bool_or(F.lower("p.subject") == F.lower("p.value")).alias("same"))
    return p.groupBy(id_column).agg(F.sum("c").alias("parsed"), F.sum(F.when(F.col("same"), F.col("c")).otherwise(0)).alias("self_lines"), F.sum(F.col("c") - 1).alias("repeats"))


def grounding(judged: DataFrame, by: str = "config", grounded_from: float = 0.5) -> DataFrame:
    """Grounded (judge score) by outcome, 2 x 2, and the share of hallucinations that are ungrounded."""
    g, c = F.col("score") >= grounded_from, F.col("outcome") == CORRECT
    d = judged.where(is_attempted("outcome") & F.col("score").isNotNull())
    return d.groupBy(by).agg(
        F.count_if(g & c).alias("grounded_correct"), F.count_if(g & ~c).alias("grounded_wrong"), F.count_if(~g & c).alias("ungrounded_correct"), F.count_if(~g & ~c).alias("ungrounded_wrong"),
        rate(~g, ~c).alias("confabulation_rate"))


def type_plausible(answer: Column, answer_type: Column, found_numbers: Column) -> Column:
    """Whether an answer holds a value of the right type at all; null for types without a shape."""
    from ..functions.text import boolean_of, full_dates, years

    return (F.when(answer_type == "boolean", boolean_of(answer).isNotNull())
            .when(answer_type == "date", (F.size(years(answer)) > 0) | (F.size(full_dates(answer)) > 0))
            .when(answer_type == "numerical", F.size(found_numbers) > 0))


def latency(samples: DataFrame, by: str, parts: tuple[str, ...]) -> DataFrame:
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    timed = samples.withColumn("_t", total)
    out = timed.groupBy(by).agg(F.avg("_t").alias("mean_total"))
    for part, name in [*[(p, f"median_{p}") for p in parts], ("_t", "median_total")]:
        out = _with(out, [by], exact_median(timed, [by], part, name))
    return out


def judge_agreement(cases: DataFrame, judged: DataFrame) -> DataFrame:
    """Human against judge scores of the same (config, id): exact share and mean absolute difference, rejected claims, incomplete decompositions.

    Optional columns of cases: claims (array of struct(valid, supported)) and
    complete (whether the decomposition covers the answer).
    """
    j = cases.join(judged.select("config", "id", F.col("score").alias("judge")), ["config", "id"])
    both = F.col("human").isNotNull() & F.col("judge").isNotNull()
    d = F.when(both, F.abs(F.col("human") - F.col("judge")))
    claims = "claims" in cases.columns
    rejected = F.size(F.filter("claims", lambda c: ~c["valid"])) if claims else F.lit(0)
    return j.agg(
        F.count_if(both).alias("n"), rate(d < 0.005, both).alias("exact_share"), F.avg(d).alias("mean_abs_difference"),
        F.coalesce(F.sum(F.when(both, F.greatest(rejected, F.lit(0)))), F.lit(0)).alias("n_rejected_claims"),
        (F.count_if(both & ~F.col("complete")) if "complete" in cases.columns else F.lit(0).cast("bigint")).alias("n_incomplete"))


def truncated_keys(rows: DataFrame, key: str, truncated: str) -> DataFrame:
    """Keys and the directions whose caps were reached."""
    return rows.select(key, F.array_sort(F.map_keys(F.map_filter(truncated, lambda _, v: v))).alias("directions")).where(F.size("directions") > 0)


def state_counts(states: DataFrame, key: str) -> DataFrame:
    """Keys by cache state, with the first five of each."""
    distinct = states.select("state", F.col(key).alias("_key")).distinct()
    first = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy("_key"))).where("_r <= 5").groupBy("state").agg(F.array_sort(F.collect_list("_key")).alias("samples"))
    return _with(distinct.groupBy("state").agg(F.count("_key").alias("n")), ["state"], first)


def usage_cost(calls: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """Totals of calls and tokens, and their price at so much for a million tokens."""
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
                     (F.sum("prompt_tokens") / 1e6 * prompt_price + F.sum("completion_tokens") / 1e6 * completion_price).alias("cost"))


def accounting(judged: DataFrame, by: str = "config") -> DataFrame:
    """Abstentions, others, unscored and scoreable attempts must add up to all."""
    att = is_attempted("outcome")
    parts = [F.count_if(F.col("outcome") == ABSTENTION), F.count_if(F.col("outcome") == OTHER), F.count_if(att & F.col("score").isNull()), F.count_if(att & F.col("score").isNotNull())]
    return judged.groupBy(by).agg(*[p.alias(n) for p, n in zip(parts, ("abstained", "other", "unscored", "scoreable"), strict=True)], F.count(F.lit(1)).alias("n"), (sum(parts[1:], parts[0]) == F.count(F.lit(1))).alias("adds_up"))


def composition(rows: DataFrame, column: str) -> DataFrame:
    """Value counts and shares."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def histogram(rows: DataFrame, column: str, least: float, most: float, bins: int) -> DataFrame:
    return rows.groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(least), F.lit(most), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def compared(computed: DataFrame, stored: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Each metric beside its stored value, and whether they agree."""
    s = stored.withColumnRenamed("value", "stored")
    return computed.join(s, keys, "full_outer").withColumn("matches", F.col("value").eqNullSafe(F.col("stored")) | F.coalesce(F.abs(F.col("value") - F.col("stored")) <= tolerance, F.lit(False)))


def extremes(groups: DataFrame, by: str, value: str, name: str, ordinal: str, least_n: int = SMALL) -> DataFrame:
    """Per `by`, the groups of the highest and lowest value among those of least_n or more; the first in the vocabulary wins ties."""
    g = groups.where(F.col("n") >= least_n)
    return g.groupBy(by).agg(F.max_by(name, F.struct(F.col(value), -F.col(ordinal))).alias("highest"), F.min_by(name, F.struct(F.col(value), F.col(ordinal))).alias("lowest"))


def f1_identity(aggregated: DataFrame) -> DataFrame:
    """F1 over all is coverage times F1 over attempts, since all else counts as 0."""
    return aggregated.withColumn("holds", F.abs(F.col("f1") - F.col("coverage") * F.col("f1_attempted")) < 1e-9)


def rank_swaps(rates: DataFrame, thresholds: tuple[str, str]) -> DataFrame:
    """Pairs of configs whose order by two columns differs."""
    one, two = thresholds
    a = rates.select(*[F.col(c).alias(f"a_{c}") for c in ("config", one, two)])
    b = rates.select(*[F.col(c).alias(f"b_{c}") for c in ("config", one, two)])
    flips = (F.col(f"a_{one}") < F.col(f"b_{one}")) != (F.col(f"a_{two}") < F.col(f"b_{two}"))
    return a.join(b, (F.col("a_config") < F.col("b_config")) & flips).select("a_config", "b_config")


def ordering(rates: DataFrame, value: str) -> DataFrame:
    """One row: the configs from the least value to the most, joined by '<'."""
    return rates.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(value, "config"))), lambda s: s["config"]), " < ").alias("ordering"))
