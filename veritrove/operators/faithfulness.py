"""Context support of answers: claims and verdicts parsed from judge texts, and their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, text

VERDICT = "(?i)^\\s*(\\d+)\\s*[.)]?\\s*.*?\\b(SUPPORTED|UNSUPPORTED)\\b"
VERSION = 3


def _lines(c: Column | str) -> Column:
    return F.split(text(c), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\u0085\\u2028\\u2029]")


def _plain(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\\*\\*|__|\\*|_", ""))


def claims(raw: Column | str) -> Column:
    """Bulleted or numbered lines; one line without a mark is a claim too."""
    mark = "(?U)^(?:[-*•]|\\d+[.)])\\s+(.*)$"
    found = F.filter(F.transform(_lines(raw), lambda line: F.when(strip(line).rlike(mark), strip(F.regexp_extract(strip(line), mark, 1)))), lambda c: c.isNotNull() & (c != ""))
    whole = strip(raw)
    single = (F.size(found) == 0) & (whole != "") & (F.size(_lines(whole)) == 1)
    return F.when(single, F.array(_plain(whole))).otherwise(F.transform(found, _plain))


def _marks(raw: Column | str) -> Column:
    parsed = F.transform(_lines(raw), lambda line: F.struct(F.regexp_extract(line, VERDICT, 1).try_cast("int").alias("i"), (F.upper(F.regexp_extract(line, VERDICT, 2)) == "SUPPORTED").alias("v")))
    return F.filter(parsed, lambda p: p["i"].isNotNull())


def verdicts(raw: Column | str, n: Column) -> Column:
    """The verdict on each of n claims; null where there is none or two that differ."""
    marks = _marks(raw)

    def of(i: Column) -> Column:
        said = F.array_distinct(F.transform(F.filter(marks, lambda m: m["i"] == i), lambda m: m["v"]))
        return F.when(F.size(said) == 1, F.get(said, F.lit(0)))

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), of)).otherwise(F.array().cast("array<boolean>"))


def out_of_range(raw: Column | str, n: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(_marks(raw), lambda m: m["i"]), lambda i: (i < 1) | (i > n))))


def scored(rows: DataFrame) -> DataFrame:
    """Adds claims, verdicts, counts, status and score.

    Needs answer, context, raw_claims, raw_verdicts, raw_repair (null if none
    was asked for). A repair fills verdicts that are missing and overturns none.
    """
    r = rows.withColumn("claims", F.when(strip("answer") == "", F.array().cast("array<string>")).otherwise(claims("raw_claims")))
    n = F.size("claims")
    r = r.withColumn("verdicts", F.zip_with(verdicts("raw_verdicts", n), verdicts("raw_repair", n), lambda a, b: F.coalesce(a, b)))
    r = (
        r.withColumn("n_claims", n).withColumn("n_supported", F.size(F.filter("verdicts", lambda v: v)))
        .withColumn("n_parsed", F.size(F.filter("verdicts", lambda v: v.isNotNull())))
        .withColumn("n_unparsed", F.col("n_claims") - F.col("n_parsed")).withColumn("repair_used", F.col("raw_repair").isNotNull())
        .withColumn("parse_coverage", F.try_divide(F.col("n_parsed").cast("double"), F.col("n_claims")))
    )
    status = F.when(strip("context") == "", "no_context").when(strip("answer") == "", "no_answer").when(F.col("n_claims") == 0, "no_claims").when(F.col("n_unparsed") > 0, "unparsed_verdicts").otherwise("ok")
    share = F.try_divide(F.col("n_supported").cast("double"), F.col("n_parsed"))
    return (
        r.withColumn("status", status).withColumn("score", F.when(F.col("status") == "ok", share))
        .withColumn("partial_score", F.when(F.col("status") == "unparsed_verdicts", share)).withColumn("instrument_version", F.lit(VERSION))
    )


# What the judge is asked.
DECOMPOSE = "List the factual claims of the answer, one a line, each with a dash."
VERIFY = "For each numbered claim write its number and SUPPORTED or UNSUPPORTED by the context."


def judged(rows: DataFrame, complete) -> DataFrame:
    """Scores answers by a judge: claims are asked for, then verdicts, then once more where some are missing.

    Needs question, answer, context. complete: prompt -> text. A call that
    fails leaves the status 'error' and no score; rows without a context or an
    answer are never sent.
    """
    from ..plans.pipelines import completed

    ask = lambda *parts: F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    numbered = F.array_join(F.transform("_claims", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    sent = (strip("context") != "") & (strip("answer") != "")
    calls = rows.where(sent).withColumn("_p", ask(DECOMPOSE, F.col("question"), F.col("answer")))
    calls = completed(calls, "_p", complete, "raw_claims", "_e1").withColumn("_claims", claims("raw_claims"))
    calls = completed(calls.withColumn("_p", ask(VERIFY, F.col("context"), numbered)), "_p", complete, "raw_verdicts", "_e2")
    open_ = F.exists(verdicts("raw_verdicts", F.size("_claims")), lambda v: v.isNull())
    again = completed(calls.where(open_).withColumn("_p", ask(VERIFY, F.col("context"), numbered, "Some verdicts were missing.")), "_p", complete, "raw_repair", "_e3")
    none = F.lit(None).cast("string")
    failed = F.col("_e1").isNotNull() | F.col("_e2").isNotNull()
    every = again.drop("_e3").unionByName(calls.where(~F.coalesce(open_, F.lit(False))).withColumn("raw_repair", none)).withColumn("_failed", failed).drop("_p", "_claims", "_e1", "_e2")
    unsent = rows.where(~sent).withColumn("raw_claims", none).withColumn("raw_verdicts", none).withColumn("raw_repair", none).withColumn("_failed", F.lit(False))
    done = scored(every.unionByName(unsent))
    return done.withColumn("status", F.when(F.col("_failed"), "error").otherwise(F.col("status"))).withColumn("score", F.when(~F.col("_failed"), F.col("score"))).drop("_failed")


def context_of(captured: Column) -> Column:
    """The context text of what a run stored: a bare string, or the JSON of a record with a context; '' for neither."""
    inside = F.get_json_object(captured, "$.context")
    return F.coalesce(F.when(F.try_parse_json(captured).isNotNull() & captured.startswith("{"), inside).otherwise(captured), F.lit(""))


def judge_jobs(scores: DataFrame, rows: DataFrame, configs: tuple[str, ...], per_config: int | None = None) -> DataFrame:
    """What a judge is asked about: attempted answers of retrieval configs with their texts, in the order of configs and ids.

    rows: question_id, question, and maps answers and contexts by config.
    per_config: a slice of each config, for a short run.
    """
    from ..functions.text import is_attempted

    place = F.create_map(*[F.lit(x) for i, c in enumerate(configs) for x in (c, i)])
    tried = scores.where(is_attempted("outcome") & F.col("config").isin(*configs)).select("question_id", "config", "outcome")
    jobs = tried.join(rows.select("question_id", "question", "answers", "contexts"), "question_id").select(
        "question_id", "config", "outcome", "question", F.coalesce(F.element_at("answers", F.col("config")), F.lit("")).alias("answer"),
        context_of(F.coalesce(F.element_at("contexts", F.col("config")), F.lit(""))).alias("context"), F.element_at(place, F.col("config")).alias("config_pos"))
    if per_config is not None:
        jobs = jobs.withColumn("_rn", F.row_number().over(Window.partitionBy("config").orderBy("question_id"))).where(F.col("_rn") <= per_config).drop("_rn")
    return jobs.orderBy("config_pos", "question_id")


def with_contexts(cases: DataFrame, contexts: DataFrame) -> DataFrame:
    """Cases beside the context of their (config, id); cases without one stay, with null. contexts: config, id, captured."""
    found = contexts.select(F.col("config").alias("_c"), F.col("id").alias("_i"), F.nullif(context_of(F.col("captured")), F.lit("")).alias("context"))
    return cases.join(found, (F.col("config") == F.col("_c")) & (F.col("id") == F.col("_i")), "left").drop("_c", "_i")
