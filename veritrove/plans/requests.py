"""One question asked by a reader: checked, answered over prepared lines, and shown with its evidence."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entities import badge, evidence_of
from ..functions.text import classify_outcome
from ..operators.checks import request_fault
from . import pipelines as P

_running = threading.Lock()


class Busy(RuntimeError):
    """A request is being answered already."""


def answer_request(spark: SparkSession, body: object, lines: DataFrame, configs: tuple[str, ...], complete: P.Completer = P.extractive, presets: dict[str, dict] | None = None) -> dict:
    """{"error": why} for a request that can't be taken; else config, answer, outcome, badge, evidence and error of its one run.

    body: question, config and entities ({"qid", "label"}), or the name of a
    preset that has them. One request runs at a time; another raises Busy.
    """
    if isinstance(body, dict) and (presets or {}).get(body.get("preset")) is not None:
        body = {**presets[body["preset"]], **{k: v for k, v in body.items() if k != "preset"}}
    if fault := request_fault(body, configs):
        return {"error": fault}
    if not _running.acquire(blocking=False):
        raise Busy("a request is running")
    try:
        entities = body.get("entities", [])
        row = (1, body["question"], [e["qid"] for e in entities], [e.get("label", e["qid"]) for e in entities])
        q = spark.createDataFrame([row], "question_id int, question string, qids array<string>, entity_names array<string>")
        graph = body["config"] in ("graph_rag", "rerank")
        rows = P.base_answers(q.withColumn("context", F.lit("")), complete) if not entities else P.condensed_answers(q, lines, complete=complete) if body["config"] == "rerank" else P.rag_answers(q, lines, facts=graph, complete=complete)
        outcome = classify_outcome("answer", F.lit(0.0))
        r = rows.select("answer", F.col("error").alias("e"), outcome.alias("outcome"), badge(outcome, F.col("answer")).alias("badge"), evidence_of(F.lit(body["config"]), F.col("context")).alias("evidence")).first()
        return {"config": body["config"], "answer": r.answer, "outcome": r.outcome, "badge": r.badge, "evidence": list(r.evidence), "error": r.e.asDict() if r.e else None}
    finally:
        _running.release()
