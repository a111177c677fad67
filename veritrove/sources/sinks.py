"""Sinks: partial results and resuming, run lifecycle, history, annotations, reports. Keyed caches are in `cache`."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cache import put_text


def append_partial(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def signature_matches(old: dict, new: dict, fields: tuple[str, ...]) -> list[str]:
    """Fields in which a stored run differs from the one that would resume it."""
    return [f for f in fields if old.get(f) != new.get(f)]


#: What a stored run must share with the one that resumes it.
SIGNATURE = (
    "code", "sample", "model", "temperature", "prompts", "retrieval", "embedding", "top_k", "allocation", "noise_filter", "rank_policy", "configs", "workers", "rate", "preflight",
)


def read_partial(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Finished rows of partial results; a line that isn't whole JSON fails and names itself."""
    lines = spark.read.text(path)
    torn = F.raise_error(F.concat(F.lit("a torn line: "), F.substring("value", 1, 80))).cast("string")
    whole = lines.where(F.trim("value") != "").select(F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(torn).alias("value"))
    return whole.select(F.from_json("value", schema).alias("r")).select("r.*")


def resumable(old: dict, new: dict) -> None:
    """Fails unless a stored run's signature is that of the run that would resume it."""
    if different := signature_matches(old, new, SIGNATURE):
        raise ValueError(f"can't resume: {', '.join(different)} changed")


def resume(questions: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Questions still open. Results of unknown questions, or two of one, are errors."""
    if not done.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a finished question occurs twice")
    if not done.join(questions.select(key), key, "left_anti").isEmpty():
        raise ValueError("a finished question isn't of this run")
    return questions.join(done.select(key), key, "left_anti")


def finished(questions: DataFrame, done: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """All results in question order."""
    return questions.select(key, "pos").join(done.unionByName(fresh, allowMissingColumns=True), key).orderBy("pos")


def write_results(rows: DataFrame, path: str, order: str = "pos") -> None:
    rows.orderBy(order).write.mode("overwrite").json(path)


def manifest(spark: SparkSession, settings: dict, path: str) -> None:
    """A run's settings beside its tables, with the session's."""
    conf = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")}
    spark.createDataFrame([(json.dumps({"settings": settings, "spark": conf}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def latest(history: DataFrame, order: str, most: int = 20) -> DataFrame:
    """The last records of a history, newest first."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(order))
    return history.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def merge_annotations(existing: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("config", "id"), hashes: tuple[str | None, str | None] = (None, None), filled: str | None = None) -> DataFrame:
    """Existing cases as they are, and new ones of keys that they lack.

    hashes: of the judge files of both. Where they differ and a case has its
    hand-filled column set, the merge is refused.
    """
    if filled and hashes[0] != hashes[1] and not existing.where(F.col(filled).isNotNull()).isEmpty():
        raise ValueError("cases annotated for another judge file")
    return existing.unionByName(fresh.join(existing.select(*keys), list(keys), "left_anti"))


def overlay(frozen: DataFrame, demo: DataFrame, key: str, value: str) -> DataFrame:
    """Frozen entries over demo ones; entries of the demo alone stay."""
    f, d = frozen.select(key, F.col(value).alias("_f")), demo.select(key, F.col(value).alias("_d"))
    return f.join(d, key, "full_outer").select(key, F.coalesce("_f", "_d").alias(value))


def _text(spark: SparkSession, path: str) -> str | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def start_snapshot(spark: SparkSession, folder: str, settings: dict) -> None:
    """A run's settings, written once at its start; a second start with others is refused."""
    text, there = json.dumps(settings, sort_keys=True), _text(spark, f"{folder}/start.json")
    if there is not None and json.loads(there) != settings:
        raise ValueError("the run has started with other settings")
    if there is None:
        put_text(spark, f"{folder}/start.json", text)


def finalise(spark: SparkSession, folder: str, raw_hash: str, scorer: str, figures: dict) -> list[dict]:
    """A run's scoring records. The raw results must be those of the first record; another scorer appends a record, the same one renews the last."""
    there = _text(spark, f"{folder}/final.json")
    records = json.loads(there) if there else []
    if records and records[0]["raw_hash"] != raw_hash:
        raise ValueError("the raw results aren't those that were finalised")
    record = {"raw_hash": raw_hash, "scorer": scorer, "figures": figures}
    records = [*(records[:-1] if records and records[-1]["scorer"] == scorer else records), record]
    put_text(spark, f"{folder}/final.json", json.dumps(records, sort_keys=True))
    return records


def log_call(rows: DataFrame, path: str) -> str | None:
    """Appends call records as JSON lines; what goes wrong is returned and stops nothing."""
    try:
        rows.write.mode("append").json(path)
    except Exception as e:  # noqa: BLE001  a log must not end what it logs
        return f"{type(e).__name__}: {e}"
    return None


def write_reports(spark: SparkSession, folder: str, texts: dict[str, str], check: bool = False) -> list[str]:
    """Report files by name. With check nothing is written: the names whose files differ from the texts are returned."""
    different = [n for n, t in sorted(texts.items()) if _text(spark, f"{folder}/{n}") != t]
    if not check:
        for n in different:
            put_text(spark, f"{folder}/{n}", texts[n])
    return different


def json_report(table: DataFrame, most: int = 10_000) -> str:
    """A small result table as a JSON list, in its order."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report table must be an aggregate")
    return json.dumps([r.asDict(recursive=True) for r in rows], default=str, sort_keys=True, indent=1)


def fmt_delta(share: float | None) -> str:
    """A signed difference of shares in percentage points."""
    return "—" if share is None else f"{100 * share:+.1f}"


def fmt_interval(low: float | None, high: float | None) -> str:
    return "—" if low is None or high is None else f"[{fmt_delta(low)}, {fmt_delta(high)}]"


def fmt_small(text: str, n: int, least: int = 50) -> str:
    """Marks a figure of few rows."""
    return f"{text}†" if n < least else text


def markdown(table: DataFrame, most: int = 10_000) -> str:
    """A small result table as Markdown; rounding is the caller's."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report table must be an aggregate")
    line = lambda cells: "| " + " | ".join("—" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(table.columns), "|" + "---|" * len(table.columns), *[line(r) for r in rows]])


_PAGE = """<!doctype html>
<meta charset="utf-8"><title>{title}</title>
<style>body{{font-family:sans-serif;margin:2em}}table{{border-collapse:collapse;margin-top:1em}}td,th{{border:1px solid #999;padding:.3em .6em;text-align:left}}</style>
<h1>{title}</h1>
<label>Table <select onchange="for (const s of document.querySelectorAll('section')) s.hidden = s.id !== this.value">{options}</select></label>
{sections}
"""


def html_report(title: str, tables: dict[str, DataFrame], most: int = 10_000) -> str:
    """Small result tables as one page without links to elsewhere: a choice of tables, every cell as text; the first is shown."""
    escaped = lambda v: html.escape("—" if v is None else str(v))
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escaped(c)}</{tag}>" for c in cells) + "</tr>"
    sections, options = [], []
    for i, (name, table) in enumerate(tables.items()):
        rows = table.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("a report table must be an aggregate")
        options.append(f'<option value="t{i}">{escaped(name)}</option>')
        sections.append(f'<section id="t{i}"{" hidden" * (i > 0)}><table>{row(table.columns, "th")}{"".join(row(r, "td") for r in rows)}</table></section>')
    return _PAGE.format(title=escaped(title), options="".join(options), sections="\n".join(sections))


def fmt_p(p: float | None) -> str:
    return "—" if p is None else "<.001" if p < 0.001 else f"{p:.3f}"


def fmt_pct(share: float | None) -> str:
    return "—" if share is None else f"{100 * share:.1f}"
