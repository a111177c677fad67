"""Scoring: long (question, config) answers against golds, into a table of scores and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T

CONFIGS = ("base_llm_abstain", "rag", "graph_rag", "rerank")


def unpivot_answers(results: DataFrame, configs=CONFIGS) -> DataFrame:
    """One row for each question and config seen in answers or errors; unknown configs are dropped."""
    empty = F.create_map().cast("map<string,string>")
    get = lambda m, c: F.element_at(F.coalesce(F.col(m), empty), c)
    parts = F.array(*[
        F.struct(F.lit(c).alias("config"), F.lit(i).alias("config_pos"), get("answers", c).alias("answer"), get("errors", c).alias("error"),
                 get("finish_reasons", c).alias("finish_reason"), get("contexts", c).alias("context"),
                 F.element_at(F.coalesce(F.col("context_words"), F.create_map().cast("map<string,int>")), c).alias("stored_words"),
                 (F.map_contains_key(F.coalesce(F.col("answers"), empty), c) | F.map_contains_key(F.coalesce(F.col("errors"), empty), c)).alias("there"))
        for i, c in enumerate(configs)
    ])
    fixed = [c for c in results.columns if c not in ("answers", "contexts", "context_words", "finish_reasons", "errors")]
    rows = results.select(*fixed, F.explode(parts).alias("_a")).select(*fixed, "_a.*").where("there").drop("there")
    failed = F.col("error").isNotNull() | F.coalesce(F.col("answer").startswith("ERROR:"), F.lit(False))
    return rows.withColumn("failed", failed).withColumn("context_words", T.word_count("context", F.col("stored_words"))).drop("stored_words")


def without_failures(rows: DataFrame, per_config: bool = False) -> DataFrame:
    """Rows of questions where no config failed; per_config drops the failed rows alone."""
    if per_config:
        return rows.where(~F.col("failed"))
    bad = rows.where("failed").select("id").distinct()
    return rows.join(bad, "id", "left_anti")


def gold_forms(expected: Column, labels: Column, value: Column, answer_type: Column) -> Column:
    """Acceptable forms: mention, labels, and for dates the typed value; [''] where there is none."""
    value = F.when(answer_type == "date", F.nullif(value, F.lit("")))
    forms = F.array_distinct(F.filter(F.concat(F.array(expected), F.coalesce(labels, F.array().cast("array<string>")), F.array(value)), lambda f: f.isNotNull() & (f != "")))
    return F.when(F.size(forms) == 0, F.array(F.lit(""))).otherwise(forms)


def distinct_members(labels: Column) -> Column:
    """Labels that differ after normalisation, the first of each, in order."""
    keyed = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda m: F.struct(T.normalize(m).alias("k"), m.alias("m")))
    fresh = F.filter(keyed, lambda x: x["k"] != "")
    return F.transform(F.filter(F.transform(fresh, lambda x, i: F.struct(x["k"].alias("k"), x["m"].alias("m"), F.array_position(F.transform(fresh, lambda y: y["k"]), x["k"]).alias("first"), (i + 1).alias("at"))),
                                lambda x: x["first"] == x["at"]), lambda x: x["m"])


def scored(rows: DataFrame, threshold: float = T.THRESHOLD) -> DataFrame:
    """Adds set_answer, raw_em, raw_f1, raw_score, outcome, and em, f1, score, which are 0 unless attempted.

    Needs answer, forms (array), members (array), question_entities (array),
    answer_type, finish_reason. Typed matchers take the best of all forms; two
    or more members make a set, except for booleans and numbers.
    """
    best = lambda f: F.array_max(F.transform("forms", f))
    kind = F.coalesce(F.col("answer_type"), F.lit(""))
    rows = rows.withColumn("_members", distinct_members(F.col("members")))
    as_set = (F.size("_members") >= 2) & ~kind.isin("boolean", "numerical")
    rows = rows.withColumn("_set", F.when(as_set, N.set_match(F.col("answer"), F.col("_members"))))
    numeric = kind == "numerical"
    # Numbers of the answer and of each form, the forms' in one call: a list of lists.
    rows = rows.withColumn("_pred", N.numbers(F.when(numeric, F.col("answer")))).withColumn("_gold", N.numbers_of_each(F.when(numeric, F.col("forms"))))
    rows = rows.withColumn("_rivals", T.rivals(F.col("forms"), F.col("question_entities")))
    em = best(lambda g: T.exact_match("answer", g))
    f1 = best(lambda g: T.token_f1("answer", g))
    contained = best(lambda g: T.entity_match("answer", g, F.col("_rivals")))
    typed = (
        F.when(kind == "boolean", best(lambda g: T.boolean_match("answer", g)))
        .when(numeric, F.coalesce(F.array_max(F.transform("_gold", lambda g: N.numeric_match(F.col("_pred"), g))), F.lit(0.0)))
        .when(kind == "date", best(lambda g: T.date_match("answer", g)))
    )
    rows = (
        rows.withColumn("set_answer", as_set)
        .withColumn("raw_em", F.when(as_set, F.col("_set.exact")).otherwise(em))
        .withColumn("raw_f1", F.when(as_set, F.col("_set.f1")).otherwise(F.coalesce(typed, f1)))
        .withColumn("raw_score", F.when(as_set, F.col("_set.f1")).otherwise(F.coalesce(typed, F.greatest(f1, contained))))
        .withColumn("precision", F.col("_set.precision")).withColumn("recall", F.col("_set.recall"))
    )
    rows = rows.withColumn("outcome", T.classify_outcome("answer", F.col("raw_score"), F.col("finish_reason"), threshold))
    attempted = T.is_attempted("outcome")
    for c in ("em", "f1", "score"):
        rows = rows.withColumn(c, F.when(attempted, F.col(f"raw_{c}")).otherwise(0.0))
    return rows.withColumn("abstained", F.col("outcome") == T.ABSTENTION).drop("_members", "_set", "_pred", "_gold", "_rivals")


def enriched(scores: DataFrame, results: DataFrame, golds: DataFrame) -> DataFrame:
    """Scores with their contexts and golds: (question_id, config) to the results' contexts, question_id to the golds.

    Adds context, context_words, forms, answer_type and present: whether a gold
    form stands in the context, null where that means nothing.
    """
    c = results.select(F.col("question_id").alias("_q"), F.col("config").alias("_c"), "context", "context_words")
    g = golds.select(F.col("question_id").alias("_g"), "forms", F.col("answer_type").alias("_kind"))
    rows = scores.drop("context", "context_words", "forms").join(c, (F.col("question_id") == F.col("_q")) & (F.col("config") == F.col("_c"))).join(g, F.col("question_id") == F.col("_g"))
    return rows.withColumn("answer_type", F.col("_kind")).withColumn("present", T.gold_in_context("context", F.col("forms"), "answer_type")).drop("_q", "_c", "_g", "_kind")


def presence_table(rows: DataFrame, axes: tuple[str, ...] = ("outcome", "complexity", "answer_type")) -> DataFrame:
    """(config, axis, value): eligible and detected rows and median context words, per config and along each axis, in one pass."""
    d = rows.where(F.col("present").isNotNull())
    sets = [[F.col("config")], *[[F.col("config"), F.col(a)] for a in axes]]
    bit = {a: 1 << (len(axes) - 1 - i) for i, a in enumerate(axes)}
    grouped = d.groupingSets(sets, F.col("config"), *[F.col(a) for a in axes]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("eligible"), F.count_if("present").alias("detected"), F.percentile("context_words", 0.5).alias("median_words"))
    named = [(F.col("_g") == sum(bit.values()) - bit[a], a) for a in axes]
    axis = F.coalesce(*[F.when(here, F.lit(a)) for here, a in named], F.lit("all"))
    value = F.coalesce(*[F.when(here, F.col(a).cast("string")) for here, a in named])
    return grouped.select("config", axis.alias("axis"), value.alias("value"), "eligible", "detected", "median_words")


def parsed_gold_forms(gold: Column) -> Column:
    """(forms, members) of a parsed gold struct; forms are [''] where there are none."""
    forms = F.coalesce(gold["forms"], F.array().cast("array<string>"))
    return F.struct(F.when(F.size(forms) == 0, F.array(F.lit(""))).otherwise(forms).alias("forms"), F.coalesce(gold["members"], F.array().cast("array<string>")).alias("members"))
