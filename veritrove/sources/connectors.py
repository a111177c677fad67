"""Connectors to services, with the service itself passed in: a function from a request to its reply.

There is no network here; what is fixed are the retries, the pacing, what
counts as an answer, and what may be kept. Replies are fetched in the tasks
that hold the keys, one call for each key.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R
from . import cache
from .bindings import with_retries

OK, ABSENT, UNKNOWN = "ok", "absent", "unknown"


class IncompleteFetch(RuntimeError):
    """Something that had to be whole wasn't."""


def graph_bindings(post: Callable[[str], dict], query: str, attempts: int = 1, sleep=time.sleep) -> list[dict[str, str]]:
    """The rows of a graph query, each cell its plain value."""
    reply = with_retries(lambda: post(query), attempts, sleep)
    return [{k: v["value"] for k, v in row.items()} for row in reply["results"]["bindings"]]


def article(get: Callable[[str], dict | None], key: str) -> tuple[str, str | None, str | None]:
    """(state, title, text) of a key's article.

    get("title/KEY") gives {"title": ...}, with null for no article;
    get("text/TITLE") gives {"text": ...}. A reply of None or with an "error"
    says nothing: unknown isn't absent.
    """
    link = get(f"title/{key}")
    if link is None or "error" in link:
        return UNKNOWN, None, None
    if link.get("title") is None:
        return ABSENT, None, None
    page = get(f"text/{link['title']}")
    if page is None or "error" in page or page.get("text") is None:
        return UNKNOWN, link["title"], None
    return OK, link["title"], page["text"]


def articles(keys: DataFrame, get: Callable[[str], dict | None], key: str = "key") -> DataFrame:
    """(key, state, title, text) of each different key; a connector that raises leaves the state unknown."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in pdf["key"]:
                try:
                    rows.append((k, *article(get, k)))
                except Exception:  # noqa: BLE001  whatever a service raises, the answer isn't known
                    rows.append((k, UNKNOWN, None, None))
            yield pd.DataFrame(rows, columns=["key", "state", "title", "text"])

    return keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct().mapInPandas(fetch, "key string, state string, title string, text string")


def _strict(rows: DataFrame, bad: str, what: str, strict: bool) -> None:
    if strict and not (some := rows.where(bad).select("key").limit(5)).isEmpty():
        raise IncompleteFetch(f"{what}: {', '.join(r.key for r in some.collect())}")


def read_through_chunks(keys: DataFrame, cached: DataFrame, get: Callable[[str], dict | None], strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, fresh entries for the cache, keys that failed) of articles, cached ones first.

    cached: (key, state, entry), as article_states gives them. Entities without
    an article are kept as such; failures never are. strict fails on any.
    """
    wanted = keys.select(F.col("key").cast("string")).where("key is not null").distinct()
    usable = cached.where("state = 'ok'")
    fresh = articles(wanted.join(usable, "key", "left_anti"), get)
    _strict(fresh, f"state = '{UNKNOWN}'", "articles aren't known", strict)
    kept = fresh.where(F.col("state") != UNKNOWN)
    entries = kept.select("key", "title", F.when(F.col("state") == ABSENT, "no article").otherwise("fetched").alias("reason"), F.when(F.col("state") == OK, R.windows("text")).otherwise(F.array().cast("array<string>")).alias("chunks"))
    old = usable.join(wanted, "key", "left_semi").select("key", F.col("entry.title").alias("title"), F.lit("cached").alias("reason"), F.col("entry.chunks").alias("chunks"))
    chunks = old.unionByName(entries).select("key", "title", F.size("chunks").alias("n_chunks"), F.posexplode("chunks").alias("index", "text"))
    return chunks, entries, fresh.where(F.col("state") == UNKNOWN).select("key")


def read_through_statements(keys: DataFrame, cached: DataFrame, graph: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(raw statements, keys that may be cached) of keys: cached entries first, the rest from the graph.

    cached: (key, state, entry). graph: (key, redirect, direction, succeeded,
    statement) with one row at least for each direction asked of a key. Only
    keys all of whose directions succeeded may be cached; strict fails on a
    reverse direction that didn't. source_entity_id is the key asked for, after
    a redirect too.
    """
    wanted = keys.select(F.col("key").cast("string")).where("key is not null").distinct()
    usable = cached.where("state = 'ok'")
    open_ = graph.join(wanted.join(usable, "key", "left_anti"), "key", "left_semi")
    _strict(open_, "direction = 'incoming' and not succeeded", "incoming statements are incomplete", strict)
    whole = open_.groupBy("key").agg(F.bool_and("succeeded").alias("ok")).where("ok").select("key")
    new = open_.where("statement is not null").select("key", "statement.*").withColumn("source_entity_id", F.col("key")).drop("key")
    old = usable.join(wanted, "key", "left_semi").select("key", F.explode("entry.statements").alias("s")).select("s.*", "key").withColumn("source_entity_id", F.col("key")).drop("key")
    return old.unionByName(new, allowMissingColumns=True), whole


def through_cache(keys: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame], key: str = "key", usable: str = "true", strict: bool = False) -> DataFrame:
    """Entries of keys: usable ones of the keyed cache at path, the rest fetched once, written there and read back.

    fetch makes of a table of keys one of entries, and leaves out what may not
    be cached; strict fails on keys that have none then. All other entries of
    the cache stay as they are.
    """
    spark, wanted = keys.sparkSession, keys.select(key).where(F.col(key).isNotNull()).distinct()
    known = cache.entries(spark, path, wanted).where(usable).select(key) if cache.writes(spark, path) else wanted.limit(0)
    cache.upsert(fetch(wanted.join(known, key, "left_anti")), path, key)
    found = cache.entries(spark, path, wanted).where(usable)
    if strict and (left := wanted.join(found.select(key), key, "left_anti").limit(5).collect()):
        raise IncompleteFetch(f"no entries of {', '.join(str(r[0]) for r in left)}")
    return found


def prewarm(wanted: DataFrame, states: DataFrame, fetch: Callable[[DataFrame], DataFrame], refetch: bool = False) -> DataFrame:
    """Fetches keys that aren't cached, or all with refetch: what fetch makes of them. It must give (key, state, ...)."""
    keys = wanted.select("key").distinct()
    return fetch(keys if refetch else keys.join(states.where("state = 'ok'"), "key", "left_anti"))


@dataclass
class Paced:
    """A completer that keeps a rate and counts what it does; one for each task.

    model: prompt -> text, or (text, {"prompt_tokens": n, "completion_tokens": n}).
    """

    model: Callable
    per_minute: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    counts: Counter = field(default_factory=Counter)
    last: float | None = None

    def __call__(self, prompt: str) -> str:
        now = self.clock()
        if self.per_minute and self.last is not None and (wait := self.last + 60 / self.per_minute - now) > 0:
            self.sleep(wait)
            now += wait
        self.last = now
        self.counts["attempts"] += 1
        try:
            reply = self.model(prompt)
        except Exception:
            self.counts["exceptions"] += 1
            raise
        self.counts["responses"] += 1
        text, usage = reply if isinstance(reply, tuple) else (reply, {})
        self.counts.update(usage)
        return text
