"""Readers: question files, caches and their states, run results, judge records."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import is_attempted
from .splits import array_records, line_records, member_records

STATEMENT_VERSION, ARTICLE_VERSION = 8, 1


class NotQuestions(ValueError):
    """A file whose records lack what a question file has."""


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON array files, as (pos, record): file order and the record's JSON text. An empty file has none."""
    return array_records(spark, path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The records of files with one JSON text a line, as (pos, record); pos ascends in file order."""
    return line_records(spark, path)


def read_questions(spark: SparkSession, path: str, ids: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """Questions in file order (pos), of an array file or of one with a record a line. Fails if the first record isn't one."""
    records = json_lines(spark, path) if lines else json_records(spark, path)
    first = records.orderBy("pos").first()
    if first and ("questionEntity" not in first.record or '"answer"' not in first.record):
        raise NotQuestions(path)
    q = records.select("pos", F.from_json("record", schemas.QUESTION).alias("q"), F.get_json_object("record", "$.answer").alias("_a")).select("pos", "q.*", "_a")
    q = q.withColumn("answer", F.col("_a")).drop("_a")
    return q.join(ids.select("id"), "id", "left_semi") if ids is not None else q


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a file that holds strings or objects with an id."""
    v = F.try_parse_json("record")
    rec = json_records(spark, path).select(F.when(F.col("record").startswith('"'), F.try_variant_get(v, "$", "string")).otherwise(F.get_json_object("record", "$.id")).alias("id"))
    return rec.where(F.col("id").isNotNull()).distinct()


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def resolve_source(spark: SparkSession, ids: DataFrame, explicit: str | None = None, recorded: str | None = None, fallbacks: tuple[str, ...] = ()) -> tuple[str, DataFrame]:
    """The first question file, in the order explicit, recorded, fallbacks, that is there, holds questions and has every id; and its questions."""
    tried = [p for p in (explicit, recorded, *fallbacks) if p]
    for path in tried:
        try:
            questions = read_questions(spark, path)
        except (NotQuestions, AnalysisException):
            continue
        if ids.join(questions.select("id"), "id", "left_anti").isEmpty():
            return path, questions
    raise LookupError(f"no source covers every id; tried {', '.join(tried) or 'nothing'}")


def covering(ids: DataFrame, candidates: dict[str, DataFrame]) -> str:
    """The first candidate table that has every id; none is an error that names all."""
    for name, gold in candidates.items():
        if ids.join(gold.select("id"), "id", "left_anti").isEmpty():
            return name
    raise LookupError(f"no source covers every id; tried {', '.join(candidates)}")


def cache_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the text of each file, named by its key."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)\\.json$", 1).alias("key"), "value")


def _cache(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("json", F.try_parse_json("value")).withColumn("entry", F.from_json("value", schema, {"mode": "PERMISSIVE"}))


def _fingerprint_differs(fingerprint: dict[str, str]):
    return reduce(lambda a, b: a | b, [~F.col("entry.fingerprint")[k].eqNullSafe(F.lit(v)) for k, v in fingerprint.items()], F.lit(False))


def statement_cache(spark: SparkSession, path: str, fingerprint: dict[str, str] | None = None, version: int = STATEMENT_VERSION) -> DataFrame:
    return statement_states(cache_files(spark, path), fingerprint, version)


def statement_states(raw: DataFrame, fingerprint: dict[str, str] | None = None, version: int = STATEMENT_VERSION) -> DataFrame:
    """(key, state, entry) of JSON texts (key, value): malformed, stale, incomplete or ok, the first that holds."""
    c = _cache(raw, schemas.STATEMENT_CACHE)
    done = F.map_values("entry.query_succeeded")
    bad = F.coalesce(F.size(done), F.lit(0)) == 0
    state = (
        F.when(F.col("json").isNull() | ~F.trim("value").startswith("{") | F.get_json_object("value", "$.statements").isNull(), "malformed")
        .when(~F.col("entry.v").eqNullSafe(F.lit(version)) | _fingerprint_differs(fingerprint or {}), "stale")
        .when(bad | F.exists(done, lambda x: ~F.coalesce(x, F.lit(False))), "incomplete").otherwise("ok"))
    return c.select("key", state.alias("state"), "entry")


def article_cache(spark: SparkSession, path: str, fingerprint: dict[str, str] | None = None, version: int = ARTICLE_VERSION) -> DataFrame:
    return article_states(cache_files(spark, path), fingerprint, version)


def article_states(raw: DataFrame, fingerprint: dict[str, str] | None = None, version: int = ARTICLE_VERSION) -> DataFrame:
    """(key, state, entry) of JSON texts (key, value): malformed, stale (the old bare list too), failed or ok - an entity without an article is ok."""
    c = _cache(raw, schemas.ARTICLE_CACHE)
    state = (
        F.when(F.col("json").isNull(), "malformed")
        .when(~F.trim("value").startswith("{") | F.get_json_object("value", "$.chunks").isNull(), "stale")
        .when(~F.col("entry.v").eqNullSafe(F.lit(version)) | _fingerprint_differs(fingerprint or {}), "stale")
        .when(~F.coalesce("entry.fetch_succeeded", F.lit(False)), "failed").otherwise("ok"))
    return c.select("key", state.alias("state"), "entry")


def with_missing(states: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """Every wanted key's state; those without an entry are missing."""
    return wanted.select(key).distinct().join(states, key, "left").withColumn("state", F.coalesce("state", F.lit("missing")))


def cached_chunks(articles: DataFrame) -> DataFrame:
    """The windows of usable article entries."""
    ok = articles.where("state = 'ok'")
    return ok.select(F.posexplode("entry.chunks").alias("index", "text"), F.col("key").alias("source_entity_id"), F.col("entry.title").alias("title"), F.size("entry.chunks").alias("n_chunks"), F.col("entry.revision_id").alias("revision_id"))


def cached_statements(cache: DataFrame) -> DataFrame:
    """The statements of usable entries, for the key that was asked for even after a redirect."""
    return cache.where("state = 'ok'").select("key", F.explode("entry.statements").alias("s")).select("s.*", "key").withColumn("source_entity_id", F.col("key")).drop("key")


def run_results(spark: SparkSession, path: str, cell: str | None = None) -> DataFrame:
    """Result rows of a run file: a list, {results: [...]}, or {cells: {name: [...]}} with a cell."""
    text = spark.read.text(path, wholetext=True)
    inside = F.coalesce(F.get_json_object("value", f"$.cells['{cell}']") if cell else F.lit(None).cast("string"), F.get_json_object("value", "$.results"), F.col("value"))
    return text.select(F.from_json(inside, f"array<struct<{', '.join(schemas.RESULT.split(', '))}>>".replace(" string", ":string").replace(" array", ":array").replace(" map", ":map")).alias("r")).select(F.posexplode("r").alias("pos", "r")).select("pos", "r.*")


def judge_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Judge records of an array file, or of one with a record a line; two of one (config, id) are an error."""
    rows = (json_lines if lines else json_records)(spark, path).select(F.from_json("record", schemas.JUDGED).alias("r")).select("r.*")
    if not rows.groupBy("config", "id").count().where("count > 1").isEmpty():
        raise ValueError("a judge record occurs twice")
    return rows


def only_file(spark: SparkSession, pattern: str) -> str:
    """The one file that a pattern names; none or several are an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = [f.getPath().toString() for f in found or ()]
    if len(names) != 1:
        raise LookupError(f"{pattern} names {len(names)} files")
    return names[0]


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(source_hash, case): an annotation file with a hash, or a bare list; large ones are split over tasks."""
    listed = array_records(spark, path).select(F.lit(None).cast("string").alias("source_hash"), F.col("record").alias("case"))
    return member_records(spark, path, "cases", ("judge_sha256",)).select(F.col("judge_sha256").alias("source_hash"), F.col("record").alias("case")).unionByName(listed)


def cross_checked(results: DataFrame, golds: DataFrame, judged: DataFrame, configs: tuple[str, ...], scores: DataFrame | None = None) -> None:
    """What several sources of one run must agree on; any breach is an error that names it.

    With scores (question_id, config, outcome), judge records must be of
    exactly the attempted answers and have their outcomes.
    """
    faults = {
        "an id is empty or occurs twice": results.groupBy("id").count().where("count > 1 or id is null or id = ''"),
        "an id has no gold answer": results.join(golds.select("id"), "id", "left_anti"),
        "a judge record is of no result": judged.join(results.select("id"), "id", "left_anti"),
        "a judge record is of an unknown config": judged.where(~F.col("config").isin(*configs)),
        "a run failed somewhere": results.where(F.coalesce(F.size("errors"), F.lit(0)) > 0),
    }
    if scores is not None:
        tried = scores.where(is_attempted("outcome")).select(F.col("question_id").alias("id"), "config", F.col("outcome").alias("_o"))
        both = judged.select("id", "config", F.col("outcome").alias("_j")).join(tried, ["id", "config"], "full_outer")
        faults["judge records don't cover the attempts"] = both.where("_o is null or _j is null")
        faults["a judge record has another outcome"] = both.where("_o <> _j")
    for what, rows in faults.items():
        if not rows.isEmpty():
            raise ValueError(what)
