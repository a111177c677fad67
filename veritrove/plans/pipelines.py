"""Answer pipelines: prompts from ranked evidence, completed by an injected model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statements import format_facts
from ..functions.text import SENTINEL
from ..operators import retrieval as R

Completer = Callable[[str], str]

# Prompt lines and the marks of errors that pass.
ABSTAIN = f'Refuse if you don\'t find the answer and reply exactly: "{SENTINEL}"'
WITH_CONTEXT = "Use the following information to answer the question as concisely as possible."
WITHOUT_CONTEXT = "Answer the following question as concisely as possible."
TRANSIENT = ("500", "502", "503", "504", "429", "timeout", "timed out", "too many concurrent", "rate limit", "overloaded", "connection", "temporarily unavailable", "bad gateway")
ATTEMPTS, BACKOFF = 4, 2.0


class IncompleteRetrieval(RuntimeError):
    """Evidence that is known to be partial; never worth another attempt."""


def extractive(prompt: str) -> str:
    """The offline model: the first evidence line of the prompt, or the sentinel."""
    lines = [x.strip() for x in prompt.split("\n")]
    facts = [x[2:] for x in lines if x.startswith("- ")] or [x for x in lines if x.startswith("[")]
    return facts[0] if facts else SENTINEL


def is_transient(error: BaseException) -> bool:
    return not isinstance(error, IncompleteRetrieval) and any(m in str(error).lower() for m in TRANSIENT)


def attempt(complete: Completer, prompt: str, sleep=time.sleep) -> tuple[str | None, dict | None]:
    """(answer, error): exactly one of them is set."""
    for k in range(1, ATTEMPTS + 1):
        try:
            return complete(prompt), None
        except Exception as e:  # noqa: BLE001  whatever the model raises becomes data
            if k == ATTEMPTS or not is_transient(e):
                return None, {"type": type(e).__name__, "message": str(e), "transient": is_transient(e), "attempts": k}
            sleep(BACKOFF**k)
    raise AssertionError


ERROR = "struct<type:string,message:string,transient:boolean,attempts:int>"


def completed(rows: DataFrame, prompt: str, complete: Completer = extractive, answer: str = "answer", error: str = "error") -> DataFrame:
    """Adds the model's answer to a prompt column; partitions run in parallel, rows keep their columns."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [attempt(complete, p) for p in pdf[prompt]]
            yield pdf.assign(**{answer: [a for a, _ in made], error: [e for _, e in made]})

    return rows.mapInPandas(run, f"{fields}, `{answer}` string, `{error}` {ERROR}")


def prompt(question: Column, context: Column | None = None, block: Column | None = None, abstain: str = ABSTAIN) -> Column:
    """Instruction, refusal clause, entities, context, question: parts that are empty leave no trace."""
    head = F.lit((WITHOUT_CONTEXT if context is None else WITH_CONTEXT) + " " + abstain)
    parts = [head]
    if block is not None:
        parts.append(F.nullif(block, F.lit("")))
    if context is not None:
        parts.append(F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit(""))))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Question: "), question, F.lit("\nAnswer:")))


def variant(defaults: dict[str, str], variants: dict[str, dict[str, str]], name: str) -> dict[str, str]:
    """One named set of overrides over the defaults; they don't compose."""
    if name not in variants:
        raise ValueError(f"unknown variant {name!r}")
    return {**defaults, **variants[name]}


# The defaults of prompts, and variants that override some of them.
SLOTS = {"persona": "", "style": "", "instruction": WITH_CONTEXT, "abstain": ABSTAIN}
VARIANTS = {
    "plain": {},
    "expert": {"persona": "You are an expert of the question's field."},
    "brief": {"style": "Answer in as few words as possible."},
    "no_abstain": {"abstain": ""},
}
#: How a model takes its system text: as a message of its own, or before the prompt.
ROLES = {"system": True, "user": False}


def role_slots(prompts: DataFrame, name: str = "plain", role: str = "system", variants: dict[str, dict[str, str]] = VARIANTS) -> DataFrame:
    """Adds system and user texts for a named variant; models without a system role get both as one user text."""
    slots = variant(SLOTS, variants, name)
    system = " ".join(x for x in (slots["persona"], slots["style"]) if x)
    body = F.concat_ws("\n\n", F.nullif(F.lit(" ".join(x for x in (slots["instruction"], slots["abstain"]) if x)), F.lit("")), F.nullif(F.coalesce("context", F.lit("")), F.lit("")), F.col("question"))
    if ROLES[role]:
        return prompts.withColumn("system", F.lit(system)).withColumn("user", body)
    return prompts.withColumn("system", F.lit("")).withColumn("user", F.concat_ws("\n\n", F.nullif(F.lit(system), F.lit("")), body))


def base_answers(questions: DataFrame, complete: Completer = extractive) -> DataFrame:
    return completed(questions.withColumn("prompt", prompt(F.col("question"))), "prompt", complete)


def ranked_pool(questions: DataFrame, lines: DataFrame, k: int, allocation: str = "global") -> DataFrame:
    """The k best lines of each question's pool: cosine of hashed embeddings, z-scores by source entity, one cut or reserved places."""
    # Each line and question is embedded once, however many pools it is in.
    pool = R.pool(questions, lines.withColumn("_v", R.hashed_embedding("line")))
    q = questions.select("question_id", R.hashed_embedding("question").alias("_q"))
    scored = pool.join(q, "question_id").withColumn("score", R.cosine(F.col("_q"), F.col("_v"))).drop("_q", "_v")
    z = R.zscores(scored, "score", ["question_id"], "qid")
    if allocation == "floor":
        return R.floor_topk(z, "z", ["question_id"], "qid", "line", k)
    if allocation != "global":
        raise ValueError(f"unknown allocation {allocation!r}")
    return R.topk(z, "z", ["question_id"], "line", k)


def contexts(questions: DataFrame, ranked: DataFrame, facts: bool) -> DataFrame:
    """Each question with its context, its pool's best lines and their number; questions without a pool have an empty one."""
    best = ranked.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("top_lines"))
    j = questions.join(best, "question_id", "left").withColumn("top_lines", F.coalesce("top_lines", F.array().cast("array<string>")))
    rendered = format_facts(F.array_join("entity_names", ", "), F.col("top_lines")) if facts else F.array_join("top_lines", "\n\n")
    return j.withColumn("context", rendered)


def rag_answers(questions: DataFrame, lines: DataFrame, k: int = 30, facts: bool = False, allocation: str = "global", complete: Completer = extractive) -> DataFrame:
    """Text or statement retrieval, then an answer. Questions: question_id, question, qids, entity_names."""
    c = contexts(questions, ranked_pool(questions, lines, k, allocation), facts)
    return completed(c.withColumn("prompt", prompt(F.col("question"), F.col("context"))), "prompt", complete)


def condensed_answers(questions: DataFrame, lines: DataFrame, k: int = 30, complete: Completer = extractive) -> DataFrame:
    """Statements condensed by a first call; an empty condensation falls back to the plain list and says so."""
    c = contexts(questions, ranked_pool(questions, lines, k), True).withColumn("_p", F.concat(F.lit("Condense the facts that answer the question.\n\n"), "context", F.lit("\n\nQuestion: "), "question"))
    d = completed(c, "_p", complete, "condensed", "condense_error")
    empty = F.coalesce(F.trim("condensed"), F.lit("")) == ""
    d = d.withColumn("condense_fallback", empty).withColumn("context", F.when(empty, F.col("context")).otherwise(F.col("condensed"))).drop("_p")
    return completed(d.withColumn("prompt", prompt(F.col("question"), F.col("context"))), "prompt", complete)


def wide(answers: DataFrame, configs: tuple[str, ...]) -> DataFrame:
    """Long answers (question_id, config, answer, context) as one row of maps for each question."""
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", c))))
    return answers.where(F.col("config").isin(*configs)).groupBy("question_id").agg(entry("answer").alias("answers"), entry("context").alias("contexts"))
