"""Further queries, of operators that read, join, parse and render records; registered beside those of the catalog.

Tables stand for records as in the catalog: customers are questions about
their nation, suppliers its lines, parts entities with typed values.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import numbers as N
from ..functions import statements as S
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import checks as C
from ..operators import retrieval as R
from ..operators import scoring as G
from ..operators import sections as X
from ..operators import stats as Q
from ..sources import cache, readers, sinks
from . import draws_sql
from . import pipelines as P
from .catalog import JUDGED_SQL, NORM_SQL, SCORES_SQL, judged, register, rounded, scores, t


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or in a temporary one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "veritrove-records")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pick(n: Column, *names: str) -> Column:
    """One of some strings by a number."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))


text = lambda c: F.col(c).cast("string")


# Questions and golds.


def question_records(spark, sf) -> DataFrame:
    """A question record for each customer, its answer of one of four shapes."""
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, n = F.col("c_custkey"), text("c_nationkey")
    label = lambda x: F.struct(x.alias("en"))
    one = F.struct(F.concat(F.lit("Q"), n).alias("name"), label(F.col("n_name")).alias("label"))
    two = F.struct(F.concat(F.lit("Q10"), n).alias("name"), label(F.lit("Atlantis")).alias("label"))
    answer = (
        F.when(k % 4 == 0, F.to_json(F.struct(F.lit("entity").alias("answerType"), F.array(one, two).alias("answer"), F.concat("n_name", F.lit(" and Atlantis")).alias("mention"))))
        .when(k % 4 == 1, F.to_json(F.struct(F.lit("numerical").alias("answerType"), F.array(k).alias("answer"), F.lit(" ").alias("mention"))))
        .when(k % 4 == 2, F.to_json(F.struct(F.lit("boolean").alias("answerType"), F.array(k % 8 == 2).alias("answer"), F.lit("").alias("mention"))))
        .otherwise(F.to_json(F.struct(F.lit("date").alias("answerType"), F.lit("1999-01-02").alias("answer"), F.lit("January 2, 1999").alias("mention")))))
    mention = F.struct(F.concat(F.lit("Q"), n).alias("name"), F.lit("entity").alias("entityType"), F.col("n_name").alias("label"), F.lower("n_name").alias("mention"), F.array(F.lit(5), F.lit(9)).alias("span"))
    return c.select(
        k.cast("string").alias("id"), F.concat(F.lit("Who is "), "c_name", F.lit(" of "), "n_name", F.lit("?")).alias("question"), F.col("c_mktsegment").alias("category"),
        pick(k, "easy", "hard").alias("complexityType"), F.array(mention).alias("questionEntity"), F.from_json(answer, "map<string,variant>").alias("answer"))


def questions(spark, sf) -> DataFrame:
    """The records, written to a file with one a line and read again."""
    path = scratch(spark, "questions")
    question_records(spark, sf).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return readers.read_questions(spark, path, lines=True)


QUESTION_SQL = "with q as (select c_custkey k, c_name, n_name, c_nationkey, c_mktsegment from customer join nation on n_nationkey = c_nationkey) "


@register(QUESTION_SQL + "select k::varchar id, 'Who is ' || c_name || ' of ' || n_name || '?' question, c_mktsegment category, case when k % 2 = 0 then 'easy' else 'hard' end complexity, 1 n_mentions, 'Q' || c_nationkey qid from q")
def question_scan(spark, sf):
    return questions(spark, sf).select("id", "question", "category", F.col("complexityType").alias("complexity"), F.size("questionEntity").alias("n_mentions"), F.col("questionEntity")[0]["name"].alias("qid"))


@register(QUESTION_SQL + """select k::varchar id, ['entity', 'numerical', 'boolean', 'date'][1 + k % 4] answer_type,
case k % 4 when 0 then n_name || '|Atlantis|' || n_name || ' and Atlantis' when 1 then k::varchar when 2 then case when k % 8 = 2 then 'Yes' else 'No' end else '1999-01-02|January 2, 1999' end forms,
case when k % 4 = 0 then n_name || '|Atlantis' else '' end members, case when k % 4 = 0 then 'Q' || c_nationkey || '|Q10' || c_nationkey else '' end qids from q""")
def gold_scan(spark, sf):
    """Gold answers of every shape, and their forms, members and keys."""
    g = questions(spark, sf).select("id", E.gold_answer(F.col("answer")).alias("g")).withColumn("p", G.parsed_gold_forms(F.col("g")))
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return g.select("id", "g.answer_type", joined("p.forms").alias("forms"), joined("p.members").alias("members"), joined("g.qids").alias("qids"))


@register("select distinct c_nationkey::varchar id from customer where c_custkey % 3 <> 2")
def id_list_scan(spark, sf):
    """Ids written as strings and as objects in one array file, read as a set."""
    c = t(spark, sf, "customer").where("c_custkey % 3 <> 2")
    item = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(text("c_nationkey").alias("id")))).otherwise(F.concat(F.lit('"'), text("c_nationkey"), F.lit('"')))
    path = scratch(spark, "ids")
    c.agg(F.concat(F.lit("["), F.array_join(F.collect_set(item), ","), F.lit("]")).alias("value")).write.text(path)
    return readers.read_ids(spark, path)


@register("select 'second' source, count(distinct c_nationkey) n from customer")
def source_coverage(spark, sf):
    """The first of two gold tables that has every id: the one without a nation doesn't."""
    c = t(spark, sf, "customer").select(text("c_nationkey").alias("id")).distinct()
    name = readers.covering(c, {"first": c.where("id <> '0'"), "second": c})
    return c.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"))




def mentions(spark, sf) -> DataFrame:
    """(k, mentions): the nation as an entity said twice, and one literal of three kinds before it."""
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, key = F.col("c_custkey"), F.concat(F.lit("Q"), text("c_nationkey"))
    none = F.lit(None).cast("string")
    m = lambda name, kind, label, said, a, b: F.struct(name.alias("name"), F.lit(kind).alias("entityType") if isinstance(kind, str) else kind.alias("entityType"), label.alias("label"), said.alias("mention"), F.array(F.lit(a), F.lit(b)).alias("span"))
    literal = m(F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "-1").otherwise("XXXX-03-05"), pick(k, "cardinal", "ordinal", "date"), none, F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "final").otherwise("early March"), 0, 2)
    return c.select(k.alias("k"), F.array(m(key, "entity", F.col("n_name"), F.concat(F.lit("that "), "n_name"), 30, 40), m(key, "entity", F.col("n_name"), F.lower("n_name"), 5, 9), literal).cast(E.ARRAY).alias("mentions"))


@register(QUESTION_SQL + """select k, 'Question entities:' || chr(10) || case k % 3 when 0 then '- (cardinal): ' || k when 1 then '- (ordinal): last — mentioned as "final"' else '- (date): March 5 (any year) — mentioned as "early March"' end
|| chr(10) || '- Q' || c_nationkey || ' (entity): ' || n_name || ' — mentioned as "that ' || n_name || '"' block,
'Question entities:' || chr(10) || '- Q' || c_nationkey || ' (entity): ' || n_name || ' — mentioned as "that ' || n_name || '"' entity_block from q""")
def entity_blocks(spark, sf):
    """Mentions of a question as the block that a prompt shows: merged, in reading order, literals first where they stand first."""
    return mentions(spark, sf).select("k", E.prompt_block(F.col("mentions")).alias("block"), E.prompt_block(F.col("mentions"), "entity").alias("entity_block"))


@register(QUESTION_SQL + "select k, ['cardinal', 'ordinal', 'date'][1 + k % 3] || ',entity' kinds, 'Q' || c_nationkey qids, lower(n_name) surface, n_name \"label\", true round_trip from q")
def entity_packages(spark, sf):
    """Packages in reading order, their keys and earliest surfaces, and the same after a trip through JSON."""
    m = mentions(spark, sf).withColumn("p", E.packages(F.col("mentions")))
    back = E.packages_from_json(E.packages_to_json(F.col("p")))
    part = lambda f: F.array_join(E.linked(F.col("mentions"), f), ",")
    same = F.to_json(back) == F.to_json("p")
    return m.select("k", F.array_join(F.transform("p", lambda x: x["kind"]), ",").alias("kinds"), part("name").alias("qids"), part("surface").alias("surface"), part("label").alias("label"), same.alias("round_trip"))


@register("""select p_partkey, case p_size % 4 when 0 then 'range' when 1 then 'iso' when 2 then 'bc' else 'year' end shape, p_size::double * 1000 + 0.5 amount,
case when p_size % 2 = 0 then 'word' else 'c_word' end stripped from part""")
def surface_values(spark, sf):
    """Shapes of dates, numbers as they are written on their own, and prefixes that go."""
    size = F.col("p_size")
    shape = F.when(size % 4 == 0, "1990:1999").when(size % 4 == 1, "1990-01-02").when(size % 4 == 2, "44 BC").otherwise("1990")
    written = F.concat(size.cast("string"), pick(size, ",000.5", " 000.5", "\u00a0000.5"))
    return t(spark, sf, "part").select("p_partkey", E.date_shape(shape).alias("shape"), E.as_number(written).alias("amount"), E.without_prefix(F.when(size % 2 == 0, "q_word").otherwise("x_c_word")).alias("stripped")).withColumn(
        "stripped", F.regexp_replace("stripped", "^x_", ""))


@register("""with v as (select l_orderkey, list(l_linenumber order by l_linenumber) n from lineitem group by 1) select l_orderkey, array_to_string(list_transform(n, lambda x: 'Line ' || x), '|') texts from (select l_orderkey, list_sort(list_distinct(n)) n from v)""")
def ordered_union(spark, sf):
    """The first spelling of each text of a list, without regard to case and runs of white space."""
    v = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    spelled = F.concat(F.transform("n", lambda x: F.concat(F.lit("Line "), x.cast("string"))), F.transform("n", lambda x: F.concat(F.lit(" line   "), x.cast("string"))))
    return v.select("l_orderkey", F.array_join(E.ordered_distinct(spelled), "|").alias("texts"))


# Caches.


@register("""with s as (select s_suppkey k, 6 + s_nationkey % 4 v, s_acctbal > 2000 whole, s_suppkey % 3 <> 0 done, s_suppkey % 7 = 0 torn, 1 + s_suppkey % 4 n from supplier),
x as (select k, n, case when torn then 'malformed' when v <> 8 or not whole then 'stale' when not done then 'incomplete' else 'ok' end state from s)
select k::varchar "key", state, (case when state = 'ok' then n else 0 end)::int n_statements from x union all select '-1', 'missing', 0""")
def statement_cache_states(spark, sf):
    """Cache entries whose faults are independent of each other - torn text, an old version, other limits, a failed query - and what usable ones hold; a key never fetched is missing."""
    s, k = t(spark, sf, "supplier"), F.col("s_suppkey")
    statement = F.struct(text("s_suppkey").alias("subject_id"), F.col("s_name").alias("subject_label"), F.lit("P1").alias("property_id"), F.lit("normal").alias("rank"), text("s_suppkey").alias("statement_id"))
    entry = F.to_json(F.struct(
        (6 + F.col("s_nationkey") % 4).alias("v"), F.create_map(F.lit("label"), F.lit(True), F.lit("forward"), F.lit(True), F.lit("reverse"), k % 3 != 0).alias("query_succeeded"),
        F.create_map(F.lit("row_limit"), F.when(F.col("s_acctbal") > 2000, "4000").otherwise("10")).alias("fingerprint"), F.array_repeat(statement, (1 + k % 4).cast("int")).alias("statements")))
    raw = s.withColumn("j", entry).select(text("s_suppkey").alias("key"), F.when(k % 7 == 0, F.expr("substring(j, 1, length(j) - 5)")).otherwise(F.col("j")).alias("value"))
    states = readers.statement_states(raw, {"row_limit": "4000"})
    held = readers.cached_statements(states).groupBy(F.col("source_entity_id").alias("k")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    wanted = raw.select("key").unionByName(spark.createDataFrame([("-1",)], "key string"))
    return readers.with_missing(states, wanted).join(held, F.col("key") == F.col("k"), "left").select("key", "state", F.coalesce("n", F.lit(0)).alias("n_statements"))


@register("""with s as (select s_suppkey k, s_nationkey % 3 v, s_acctbal > 0 done, s_suppkey % 7 = 0 torn, s_suppkey % 11 = 0 bare, s_suppkey % 4 n from supplier),
x as (select k, n, case when torn then 'malformed' when bare or v <> 1 then 'stale' when not done then 'failed' else 'ok' end state from s) select k::varchar "key", state, (case when state = 'ok' then n else 0 end)::int n_chunks from x""")
def article_cache_states(spark, sf):
    """Article entries whose faults are independent - torn text, the old bare list, an old version, a failed fetch - and the windows of usable ones, some of which have none."""
    k = F.col("s_suppkey")
    chunks = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat_ws(" ", "s_name", i.cast("string")))
    entry = F.to_json(F.struct((F.col("s_nationkey") % 3).alias("v"), (F.col("s_acctbal") > 0).alias("fetch_succeeded"), F.col("s_name").alias("title"), F.slice(chunks, F.lit(1), (k % 4).cast("int")).alias("chunks")))
    value = F.when(k % 7 == 0, F.expr("substring(j, 1, length(j) - 5)")).when(k % 11 == 0, F.to_json(F.array("s_name"))).otherwise(F.col("j"))
    raw = t(spark, sf, "supplier").withColumn("j", entry).select(text("s_suppkey").alias("key"), value.alias("value"))
    states = readers.article_states(raw)
    held = readers.cached_chunks(states).groupBy("source_entity_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return states.join(held, F.col("key") == F.col("source_entity_id"), "left").select("key", "state", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@register("select state, count(*) n, array_to_string(list_sort(list(k))[1:5], ',') samples from (select s_suppkey::varchar k, ['malformed', 'stale', 'stale', 'incomplete', 'ok', 'ok'][1 + s_suppkey % 6] state from supplier) group by 1")
def cache_state_counts(spark, sf):
    s = t(spark, sf, "supplier").select(text("s_suppkey").alias("key"), pick(F.col("s_suppkey"), "malformed", "stale", "stale", "incomplete", "ok", "ok").alias("state"))
    return A.state_counts(s, "key").select("state", "n", F.array_join("samples", ",").alias("samples"))


@register("select c_custkey question_id from customer where c_nationkey % 3 <> 0 and (c_nationkey + 1) % 3 <> 0")
def ready_questions(spark, sf):
    """Questions all of whose keys are cached: those of two nations, of which every third isn't."""
    n = F.col("c_nationkey")
    q = t(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), F.array(n.cast("string"), (n + 1).cast("string")).alias("qids"))
    keys = spark.range(0, 26).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 == 0, "stale").otherwise("ok").alias("state"))
    return C.ready(q, keys)


@register("select p_partkey, case when p_partkey % 3 = 0 then 'frozen' when p_partkey % 3 = 1 then 'both' else 'demo' end origin, case when p_partkey % 3 = 2 then p_name || '!' else p_name end \"value\" from part")
def cache_overlay(spark, sf):
    """A frozen cache over a demo one, both written by key and read again."""
    p = t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("value"))
    frozen, demo = scratch(spark, "frozen"), scratch(spark, "demo")
    cache.upsert(p.where("p_partkey % 3 <> 2"), frozen, "p_partkey", 4)
    cache.upsert(p.where("p_partkey % 3 <> 0").withColumn("value", F.concat("value", F.lit("!"))), demo, "p_partkey", 4)
    f, d = cache.entries(spark, frozen), cache.entries(spark, demo)
    origin = f.select("p_partkey", F.lit(1).alias("n")).unionByName(d.select("p_partkey", F.lit(2).alias("n"))).groupBy("p_partkey").agg(F.sum("n").alias("n"))
    return sinks.overlay(f, d, "p_partkey", "value").join(origin, "p_partkey").select("p_partkey", pick(F.col("n") - 1, "frozen", "demo", "both").alias("origin"), "value")


CACHED_PARTS = """with c as (select p_partkey, case when p_size % 11 = 0 then p_type when p_size % 3 = 0 then upper(p_name) else p_name end "value", case when p_size % 11 = 0 then 3 when p_size % 3 = 0 then 2 else 1 end "round"
from part where p_size % 11 = 0 or (p_size % 7 <> 0 and (p_size % 3 = 0 or p_size <= 40)))"""


def cached_parts(spark, sf) -> str:
    """A cache of parts written in three rounds: most parts, new and changed ones, removed and changed ones, with a compaction between."""
    p, path = t(spark, sf, "part"), scratch(spark, "parts")
    entry = lambda value, n: (F.col("p_partkey"), value.alias("value"), F.lit(n).alias("round"))
    cache.upsert(p.where("p_size <= 40").select(*entry(F.col("p_name"), 1)), path, "p_partkey", 8)
    cache.upsert(p.where("p_size % 3 = 0").select(*entry(F.upper("p_name"), 2)), path, "p_partkey")
    cache.compact(spark, path)
    cache.remove(p.where("p_size % 7 = 0"), path, "p_partkey")
    cache.upsert(p.where("p_size % 11 = 0").select(*entry(F.col("p_type"), 3)), path, "p_partkey")
    return path


@register(CACHED_PARTS + " select * from c")
def cache_rounds(spark, sf):
    """Every entry of a cache after three rounds of writing."""
    return cache.entries(spark, cached_parts(spark, sf))


@register(CACHED_PARTS + """ select k.p_partkey, coalesce("round"::varchar, 'missing') state from (select distinct l_partkey p_partkey from lineitem where l_quantity > 48) k left join c using (p_partkey)""")
def cache_lookup(spark, sf):
    """The states of wanted keys in a cache of three rounds."""
    keys = t(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return cache.states(spark, cached_parts(spark, sf), keys, text("round"))


@register("""select s_suppkey, case when s_suppkey % 4 = 0 then 'old' else 'fetched' end origin, s_name || case when s_suppkey % 4 = 0 then '?' else '' end "value" from supplier where s_suppkey % 4 = 0 or s_acctbal > 0 and s_suppkey % 3 = 0
union all select s_suppkey, 'other', s_name from supplier where s_suppkey % 4 <> 0 and s_suppkey % 3 <> 0 and s_suppkey % 5 = 0""")
def read_through_cache(spark, sf):
    """Suppliers through a cache that has some of them and entries of others: those that are missing are fetched, some can't be, and all of the cache is read at the end."""
    from ..sources import connectors as K

    s, path = t(spark, sf, "supplier"), scratch(spark, "through")
    entry = lambda origin, value: (F.col("s_suppkey"), F.lit(origin).alias("origin"), value.alias("value"))
    k = F.col("s_suppkey")
    old = s.where(k % 4 == 0).select(*entry("old", F.concat("s_name", F.lit("?"))))
    cache.upsert(old.unionByName(s.where((k % 4 != 0) & (k % 3 != 0) & (k % 5 == 0)).select(*entry("other", F.col("s_name")))), path, "s_suppkey", 4)
    K.through_cache(s.where((k % 3 == 0) | (k % 4 == 0)), path, lambda keys: s.join(keys, "s_suppkey").where("s_acctbal > 0").select(*entry("fetched", F.col("s_name"))), "s_suppkey")
    return cache.entries(spark, path)


@register("select o_orderkey id, o_orderkey % 4 = 0 was_done, o_totalprice from orders")
def resumed_run(spark, sf):
    """A quarter of a run is written, the rest found open and added, and all comes in the order of the questions."""
    q = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice").withColumn("pos", F.col("id"))
    path = scratch(spark, "partial")
    sinks.append_partial(q.where("id % 8 = 0").select("id", F.col("o_totalprice").alias("x")), path)
    sinks.append_partial(q.where("id % 8 = 4").select("id", F.col("o_totalprice").alias("x")), path)
    done = sinks.read_partial(spark, path, "id bigint, x double")
    fresh = sinks.resume(q, done).select("id", F.col("o_totalprice").alias("x"))
    return sinks.finished(q, done.withColumn("was_done", F.lit(True)), fresh.withColumn("was_done", F.lit(False))).select("id", "was_done", F.col("x").alias("o_totalprice"))


@register('select event_id, row_number() over (order by ts desc, event_id desc)::int rn from events qualify rn <= 20')
def latest_records(spark, sf):
    h = t(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return sinks.latest(h, "at").select("event_id", "rn")


@register("select l_orderkey id, l_linenumber::varchar config, case when l_orderkey % 2 = 0 then 'kept' else 'new' end note from lineitem")
def merged_annotations(spark, sf):
    """Cases of even orders are there and stay; those of odd ones are added."""
    c = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), text("l_linenumber").alias("config"))
    return sinks.merge_annotations(c.where("id % 2 = 0").withColumn("note", F.lit("kept")), c.withColumn("note", F.lit("new"))).select("id", "config", "note")


# Runs.


def run_rows(spark, sf) -> DataFrame:
    """Result rows as a run file has them: maps by config."""
    s = scores(spark, sf).withColumn("config", F.when(F.col("config") == "click", "base_llm_abstain").when(F.col("config") == "view", "rag").otherwise(F.col("config")))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", c.alias("v")))))
    bad = (F.col("config") == "rag") & (F.col("question_id") % 7 == 0)
    return s.groupBy("question_id").agg(
        entry(F.when(bad, F.lit("ERROR: 503")).otherwise(F.col("outcome"))).alias("answers"), entry(F.concat(F.lit("a context of "), "outcome")).alias("contexts"),
        F.map_from_entries(F.filter(F.collect_list(F.when(F.col("config") == "rag", F.struct("config", F.lit(99).alias("v")))), lambda x: x.isNotNull())).alias("context_words"),
        entry(F.lit("stop")).alias("finish_reasons"), F.create_map().cast("map<string,string>").alias("errors")).withColumn("id", text("question_id"))


RUN_SQL = SCORES_SQL + """, r as (select question_id, case config when 'click' then 'base_llm_abstain' else 'rag' end config, outcome, config = 'view' and question_id % 7 = 0 failed from scores where config in ('click', 'view')) """


@register(RUN_SQL + """select question_id, config, case when failed then 'ERROR: 503' else outcome end answer, failed, case when config = 'rag' then 99 else 4 end context_words from r""")
def unpivoted_answers(spark, sf):
    """Answers of known configs, one row each; a stored word count wins over a counted one."""
    return G.unpivot_answers(run_rows(spark, sf)).select("question_id", "config", "answer", "failed", "context_words")


@register(RUN_SQL + "select question_id, config from r where question_id not in (select question_id from r where failed)")
def without_failed_questions(spark, sf):
    return G.without_failures(G.unpivot_answers(run_rows(spark, sf))).select("question_id", "config")


@register(RUN_SQL + "select question_id::varchar id, 'run ' || question_id question, coalesce(list(outcome) filter (config = 'rag' and not failed), [])[1] rag from r group by 1, 2")
def run_result_scan(spark, sf):
    """Result rows of a run file with cells, written and read again."""
    rows = run_rows(spark, sf).select("id", F.concat(F.lit("run "), "id").alias("question"), F.map_filter("answers", lambda _, v: ~v.startswith("ERROR")).alias("answers"))
    path = scratch(spark, "run")
    listed = rows.agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("id", "question", "answers")).alias("main")).alias("cells"))).alias("value"))  # one file, as runs write it
    listed.coalesce(1).write.text(path)
    return readers.run_results(spark, path, "main").select("id", "question", F.element_at("answers", F.lit("rag")).alias("rag"))


@register(JUDGED_SQL + "select question_id::varchar id, config, js score, status from judged")
def judge_record_scan(spark, sf):
    """Judge records, one a line; a second one of the same answer would fail."""
    j = judged(spark, sf).select(text("question_id").alias("id"), "config", "outcome", "score", "status")
    path = scratch(spark, "judged")
    j.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return readers.judge_records(spark, path, lines=True).select("id", "config", "score", "status")


@register("select 'abc' source_hash, doc_id, toxic from labels")
def sidecar_scan(spark, sf):
    """An annotation file with a hash, found by a pattern that names one file."""
    cases = t(spark, sf, "labels").select(F.lit(1).alias("part"), F.to_json(F.struct("doc_id", "toxic")).alias("value"))
    ends = spark.createDataFrame([(0, '{"judge_sha256":"abc","cases":['), (2, "]}")], "part int, value string")
    path = scratch(spark, "sidecar")
    # One file, written line by line; a case after another case has a comma before it.
    lines = cases.unionByName(ends).withColumn("before", F.lag("part").over(Window.orderBy("part")))
    lines.select(F.concat(F.when((F.col("part") == 1) & (F.col("before") == 1), ",").otherwise(""), "value").alias("value")).write.text(path)
    got = readers.sidecar(spark, readers.only_file(spark, f"{path}/part-*.txt"))
    return got.select("source_hash", F.get_json_object("case", "$.doc_id").cast("bigint").alias("doc_id"), F.get_json_object("case", "$.toxic").cast("int").alias("toxic"))


@register(JUDGED_SQL + """select config, count(*) filter (question_id % 10 = 3) excluded, count(*) filter (question_id % 10 <> 3 and js is null) unscored,
count(*) filter (question_id % 10 <> 3 and outcome <> case when raw_score >= 0.5 then 'correct' else 'hallucination' end)::int mismatches from judged group by 1""")
def consistent_records(spark, sf):
    """Judge records that take every answer for an attempt, against scores that lack a tenth of them."""
    j = judged(spark, sf).withColumn("id", F.col("question_id")).withColumn("outcome", F.when(F.col("raw_score") >= 0.5, "correct").otherwise("hallucination"))
    return C.consistent(j, scores(spark, sf).where("question_id % 10 <> 3")).withColumn("mismatches", F.col("mismatches").cast("int"))


@register("""with a as (select o_custkey id, count(*) n_a from orders where o_orderstatus = 'F' group by 1), b as (select c_custkey id, count(*) n_b from customer where c_acctbal > 0 group by 1)
select id, coalesce(n_a, 0)::int n_a, coalesce(n_b, 0)::int n_b from a full join b using (id) where n_a is null or n_b is null or n_a > 1 or n_b > 1""")
def different_ids(spark, sf):
    """Customers with finished orders against those with a balance: ids that one side lacks, or has more than once."""
    a, b = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return C.different_ids(a, b).select("id", *[F.coalesce(n, F.lit(0)).cast("int").alias(n) for n in ("n_a", "n_b")])


@register("select s_suppkey, n_name from supplier join nation on n_nationkey = s_nationkey")
def strict_lookup(spark, sf):
    """Every supplier must have its nation."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return C.strict_join(t(spark, sf, "supplier"), n, "s_nationkey").select("s_suppkey", "n_name")


@register("select p_partkey, case when p_size % 3 = 0 then p_brand else p_name end \"label\" from part")
def filled_lookup(spark, sf):
    """Labels that are null or empty take the lookup's."""
    p = t(spark, sf, "part")
    rows = p.select("p_partkey", F.when(F.col("p_size") % 6 == 0, F.lit(None)).when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("label"))
    return C.filled(rows, p.select("p_partkey", F.col("p_brand").alias("label")), "p_partkey", ("label",))


@register("""select l_orderkey, list_has_all(range(1, 2 + l_orderkey % 6), list(distinct l_linenumber::bigint)) inside, count(*) filter (l_returnflag = 'R') + count(*) filter (l_returnflag = 'A') + count(*) filter (l_linestatus = 'O') = count(*) adds_up from lineitem group by 1""")
def set_tests(spark, sf):
    """Whether an order's line numbers are among the first few, and whether three counts of its lines, which overlap, add up to all."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    o = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("bigint")).alias("s"), n("l_returnflag", "R").alias("r"), n("l_returnflag", "A").alias("a"), n("l_linestatus", "O").alias("o"), F.count(F.lit(1)).alias("n"))
    few = F.sequence(F.lit(1).cast("bigint"), 1 + F.col("l_orderkey") % 6)
    return o.select("l_orderkey", C.subset(F.col("s"), few).alias("inside"), C.partitions([F.col("r"), F.col("a"), F.col("o")], F.col("n")).alias("adds_up"))


# Statements.


@register("""with d as (select l_suppkey, l_orderkey * 10 + l_linenumber st from lineitem) select l_suppkey::varchar subject_id, st statement_id, count(*) over (partition by l_suppkey) >= 40 truncated from d qualify row_number() over (partition by l_suppkey order by st) <= 40""")
def forward_capped(spark, sf):
    """Outgoing statements of every supplier, at most 40 each, and whether there are as many."""
    s = t(spark, sf, "lineitem").select(text("l_suppkey").alias("subject_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("statement_id"))
    return R.forward(s, t(spark, sf, "supplier").select(text("s_suppkey").alias("k")), "k", 40).select("subject_id", "statement_id", "truncated")


@register("select s_suppkey, s_name from supplier where contains(lower(s_name), '0001') order by lower(s_name) = '0001' desc, length(s_name), s_name limit 5")
def entity_search(spark, sf):
    return R.search_entities(t(spark, sf, "supplier").withColumn("label", F.col("s_name")), "0001").select("s_suppkey", "s_name")


NAMES_SQL = """n as (select distinct p_name "name" from part union select n_name from nation union select '#' || s_suppkey from supplier union select lower(p_type) from part union select substr(p_name, 3, 2) from part),
e as (select 10 * p_partkey qid, p_brand || ' ' || p_type || ' ' || p_name "label" from part union all select 10 * c_custkey + 1, c_name from customer union all select 10 * n_nationkey + 2, n_name from nation)"""


@register(f"""with {NAMES_SQL} select "name", qid, "label", row_number() over (partition by "name" order by lower("label") = lower("name") desc, length("label"), "label", qid) "rank" from n join e on contains(lower("label"), lower("name")) qualify "rank" <= 5""")
def names_search(spark, sf):
    """Many names - of parts, nations, types in lower case, two letters, numbers - against labels of parts, customers and nations."""
    p, c, n, s = (t(spark, sf, x) for x in ("part", "customer", "nation", "supplier"))
    names = [p.select(F.col("p_name").alias("name")), n.select("n_name"), s.select(F.concat(F.lit("#"), text("s_suppkey"))), p.select(F.lower("p_type")), p.select(F.substring("p_name", 3, 2))]
    labels = p.select((10 * F.col("p_partkey")).alias("qid"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("label"))
    labels = labels.union(c.select(10 * F.col("c_custkey") + 1, "c_name")).union(n.select((10 * F.col("n_nationkey") + 2).cast("bigint"), "n_name"))
    return R.search_names(labels, reduce(DataFrame.union, names)).withColumn("rank", F.col("rank").cast("bigint"))


@register("""select p_partkey, case p_size % 4 when 0 then 'somevalue' else 'value' end snaktype, case p_size % 4 when 1 then 'Q' || p_partkey end id, case p_size % 4 when 0 then null when 3 then null else p_name end "label",
case p_size % 4 when 0 then 'http://x/.well-known/genid/' || p_partkey when 1 then null else 'v' || p_partkey end raw, case p_size % 4 when 2 then 'metre' end unit from part""")
def typed_values(spark, sf):
    """Bindings of unknown values, entities, quantities and unlabelled texts as typed values."""
    m, k = F.col("p_size") % 4, text("p_partkey")
    iri = F.when(m == 0, F.concat(F.lit("http://x/.well-known/genid/"), k)).when(m == 1, F.concat(F.lit("http://x/entity/Q"), k)).otherwise(F.concat(F.lit("v"), k))
    v = S.snak(iri, F.when(m == 3, F.concat(F.lit("Q"), k)).otherwise(F.col("p_name")), F.lit("Quantity"), F.when(m == 2, "metre").otherwise("1"))
    return t(spark, sf, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.snaktype", "v.id", "v.label", "v.raw", "v.unit")


def part_statements(spark, sf) -> DataFrame:
    """Statements about brands, one for each part: some deprecated, some bookkeeping, half incoming, each twice."""
    p, m = t(spark, sf, "part"), F.col("p_size")
    value = F.struct(F.lit("value").alias("snaktype"), F.when(m % 9 == 0, "ExternalId").otherwise("String").alias("datatype"), F.lit(None).cast("string").alias("id"), F.col("p_name").alias("label"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("int").alias("precision"))
    q = lambda label: F.struct(F.lit("P1").alias("property_id"), F.lit(label).alias("property_label"), value.alias("value"))
    one = p.select(
        F.col("p_partkey").alias("statement_id"), F.col("p_brand").alias("source_entity_id"), F.when(m % 2 == 0, "incoming").otherwise("outgoing").alias("direction"), F.lit("P").alias("property_id"),
        F.when(m % 7 == 0, "category of parts").otherwise("made of").alias("property_label"), F.col("p_brand").alias("subject_label"), value.alias("value"),
        F.when(m % 5 == 0, "deprecated").otherwise("normal").alias("rank"), F.array(q("catalogue id"), q("colour")).alias("qualifiers"))
    return one.unionByName(one)


CLEAN_SQL = """with s as (select *, row_number() over (partition by p_brand, p_size % 2 order by p_partkey) rn from part where p_size % 5 <> 0 and {noise})
select p_partkey statement_id, {n} n_qualifiers from s where p_size % 2 = 1 or rn <= 30"""


@register(CLEAN_SQL.format(noise="p_size % 7 <> 0 and p_size % 9 <> 0", n=1))
def clean_statements(spark, sf):
    """Repeats, ranks, bookkeeping by property type, the cap of incoming statements, and qualifiers."""
    return R.clean_statements(part_statements(spark, sf)).select("statement_id", F.size("qualifiers").alias("n_qualifiers"))


@register(CLEAN_SQL.format(noise="p_size % 7 <> 0", n=1))
def clean_statements_by_label(spark, sf):
    """The same with bookkeeping told by labels alone."""
    return R.clean_statements(part_statements(spark, sf), "label_heuristic").select("statement_id", F.size("qualifiers").alias("n_qualifiers"))


@register("select p_partkey statement_id, case when p_size % 2 = 1 and p_size % 3 = 0 then 'ours' else p_brand end subject_label, case when p_size % 2 = 0 and p_size % 3 = 0 then 'ours' else p_name end \"value\" from part")
def own_labels(spark, sf):
    """A question's own names over those of the graph: outgoing subjects and incoming values take them."""
    s = part_statements(spark, sf).dropDuplicates(["statement_id"]).join(t(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size"), F.col("statement_id") == F.col("k"))
    names = F.when(F.col("p_size") % 3 == 0, F.create_map("source_entity_id", F.lit("ours"))).otherwise(F.create_map().cast("map<string,string>"))
    return R.override_labels(s, names).select("statement_id", "subject_label", F.col("value.label").alias("value"))


@register("select s_suppkey statement_id, n_name || case when s_suppkey % 2 = 0 then ' (nation ' || n_nationkey || ')' else '' end \"value\" from supplier join nation on n_nationkey = s_nationkey")
def described_values(spark, sf):
    """A value that reads like its subject gets its description."""
    n = t(spark, sf, "nation")
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("statement_id"), F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("s_name")).alias("subject_label"), F.struct(text("n_nationkey").alias("id"), F.col("n_name").alias("label")).alias("value"))
    meta = n.select(text("n_nationkey").alias("qid"), F.concat(F.lit("nation "), text("n_nationkey")).alias("description"))
    return R.describe_collisions(s, meta).select("statement_id", F.col("value.label").alias("value"))


@register("""select n_nationkey qid, -2 line_pos, '[' || n_name || '] also known as: ' || lower(n_name) line from nation union all
select n_nationkey, case when true then -1 end, '[' || n_name || '] description: number ' || n_nationkey from nation where n_nationkey % 2 = 0""")
def metadata_lines(spark, sf):
    n = t(spark, sf, "nation")
    meta = n.select(F.col("n_nationkey").alias("qid"), F.col("n_name").alias("label"), F.array("n_name", F.lower("n_name")).alias("aliases"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("number "), text("n_nationkey"))).alias("description"))
    return R.meta_lines(meta)


@register("select distinct 'P' || (l_partkey % 50) property_id, dense_rank() over (order by l_partkey % 50)::int place from lineitem")
def numeric_order(spark, sf):
    """Properties in the order of their numbers, not of their letters."""
    st = t(spark, sf, "lineitem").select(F.lit("k").alias("value_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("property_id"))
    ordered = R.reverse_properties(st, spark.createDataFrame([("k",)], "k string"), "k")
    return ordered.select("property_id").coalesce(1).withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))


@register("select n_nationkey, case when n > 0 then 'Wikidata facts about ' || n_name || ':' || chr(10) || f else 'No relevant facts found for ' || n_name || '.' end block from (select n_nationkey, n_name, count(s_name) n, string_agg('- ' || s_name, chr(10) order by s_name) f from nation left join supplier on s_nationkey = n_nationkey and s_suppkey % 4 = 0 group by all)")
def facts_block(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "supplier").where("s_suppkey % 4 = 0"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return n.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list("s_name")).alias("f")).select("n_nationkey", S.format_facts(F.col("n_name"), F.col("f")).alias("block"))


# Answers.


@register("""select p_partkey, case p_size % 6 when 0 then 'abstention' when 1 then 'other' when 2 then 'other' when 3 then 'correct' when 4 then 'hallucination' else 'other' end outcome,
p_size % 6 = 0 compliant, p_size % 6 = 1 opens, case when p_size % 6 = 0 then 'abstained' when p_size % 6 = 3 then 'correct' else 'wrong' end three, case p_size % 6 when 0 then 'abstained' when 1 then 'refusal-shaped' when 2 then 'empty' else 'answered' end badge from part""")
def outcome_classes(spark, sf):
    """Answers of each class: the sentinel, a refusal, nothing, right, wrong, and cut off."""
    m = F.col("p_size") % 6
    a = F.when(m == 0, T.SENTINEL + " Sorry.").when(m == 1, "The context does not mention it.").when(m == 2, " ").otherwise(F.col("p_name"))
    p = t(spark, sf, "part").select("p_partkey", a.alias("a"), F.when(m == 3, 0.5).otherwise(0.1).alias("s"), F.when(m == 5, "length").otherwise("stop").alias("r"), (m == 0).alias("gone"))
    p = p.withColumn("outcome", T.classify_outcome("a", F.col("s"), F.col("r")))
    return p.select("p_partkey", "outcome", T.is_compliant_abstention("a").alias("compliant"), (T.opens_with_refusal("a") & ~F.col("gone")).alias("opens"), T.classify_three(F.col("gone"), F.col("s")).alias("three"), E.badge(F.col("outcome"), F.col("a")).alias("badge"))


SMALL = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen']"


@register("""select l_orderkey, l_linenumber, (l_quantity * 1000 + l_suppkey % 100 + 300)::double first_number, l_linenumber::double second_number, l_linenumber % 2 = 0 matches from lineitem""")
def number_words(spark, sf):
    """Quantities in words - thousands, hundreds, tens and units - beside a second number, and whether the gold's number is among them."""
    units = list(N.UNITS)[:20]
    tens = [list(N.TENS)[i] for i in range(8)]

    def spelled(n: Column) -> Column:
        unit = lambda k: F.element_at(F.array(*[F.lit(w) for w in units]), (k + 1).cast("int"))
        ten = F.element_at(F.array(*[F.lit(w) for w in tens]), F.greatest(F.lit(1), F.floor(n / 10) - 1).cast("int"))
        return F.when(n < 20, unit(F.least(n, F.lit(19)))).when(n % 10 == 0, ten).otherwise(F.concat(ten, F.lit("-"), unit(n % 10)))

    q, s = F.col("l_quantity").cast("int"), F.col("l_suppkey") % 100
    phrase = F.concat(F.lit("Some "), spelled(q), F.lit(" thousand three hundred and "), spelled(s), F.lit(" pieces; "), text("l_linenumber"), F.lit(" boxes"))
    gold = F.when(F.col("l_linenumber") % 2 == 0, F.concat(text("l_linenumber"), F.lit(" of them"))).otherwise("twelve million")
    n = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.numbers(phrase).alias("n"), N.numbers(gold).alias("g"))
    return n.select("l_orderkey", "l_linenumber", F.get("n", F.lit(0)).alias("first_number"), F.get("n", F.size("n") - 1).alias("second_number"), (N.numeric_match(F.col("n"), F.col("g")) == 1).alias("matches"))


@register("""with x as (select p_partkey, p_size % 5 m from part) select p_partkey, (case m when 0 then 1.0 when 1 then 0.5 when 2 then 1.0 / 3 when 3 then 1.0 else 0.0 end)::double "precision",
(case m when 0 then 1.0 when 1 then 0.5 when 2 then 0.5 when 3 then 1.0 else 0.0 end)::double recall, (case when m in (0, 3) then 1.0 else 0.0 end)::double "exact", case m when 0 then 2 when 1 then 2 when 2 then 3 when 3 then 3 else 0 end n_items from x""")
def set_answers(spark, sf):
    """Answers in prose against a set of two members: whole, half, repeated, with a member that 'and' parts, and empty."""
    m = F.col("p_size") % 5
    members = F.when(m == 3, F.array(F.lit("Law & Order"), F.lit("Lost"))).otherwise(F.array(F.col("p_brand"), F.lit("Iron Man")))
    answer = (
        F.when(m == 0, F.concat("p_brand", F.lit(" and the iron man"))).when(m == 1, F.concat(F.lit("1. "), "p_brand", F.lit("\n2. something else"))).when(m == 2, F.lit("Iron Man, Iron Man; iron man!"))
        .when(m == 3, "Lost & law & order").otherwise(""))
    p = t(spark, sf, "part").select("p_partkey", answer.alias("a"), N.set_match(answer, members).alias("r"))
    return rounded(p.select("p_partkey", "r.precision", "r.recall", "r.exact", F.size(T.split_set("a")).alias("n_items")), 9)


@register("""with recursive l as (select l_orderkey k, l_linenumber n, p_name, case l_linenumber % 4 when 0 then 'the ' || p_name when 1 then upper(p_name) when 2 then replace(p_name, ' ', ' big ') else split_part(p_name, ' ', 2) end item
  from lineitem join part on p_partkey = l_partkey),
i as (select k, lpad(n::varchar, 3, '0') || item n, list_filter(string_split(lower(item), ' '), lambda x: x not in ('the', 'a', 'an', '')) w from l),
d as (select k, w, row_number() over (partition by k order by min(n)) i from i group by k, w),
g as (select k, row_number() over (partition by k order by p_name) g, string_split(lower(p_name), ' ') w from (select distinct k, p_name from l)),
c as (select k, i, list(g order by f desc, g desc) filter (f >= 0.5) c from (select k, i, g, 2.0 * len(list_intersect(d.w, g.w)) / (len(d.w) + len(g.w)) f from d join g using (k)) group by k, i),
r(k, i, free, hits) as (select k, 0, list(g), 0 from g group by k union all
  select k, i + 1, list_filter(free, lambda x: x is distinct from p), hits + (p is not null)::int from (select r.k, r.i, free, hits, list_filter(coalesce(c, []), lambda x: list_contains(free, x))[1] p from r join c on c.k = r.k and c.i = r.i + 1))
select k l_orderkey, round(max(hits) / any_value(claims), 6) "precision", round(max(hits) / any_value(golds), 6) recall, (max(hits) = any_value(golds) and any_value(claims) = any_value(golds))::int::double "exact", any_value(claims) n_items
from r join (select k, count(*) claims from i group by 1) using (k) join (select k, count(*) golds from g group by 1) using (k) group by k""")
def set_lists(spark, sf):
    """The parts of an order as a list in prose against its set of parts: with articles, in capitals, with a word more or less, some said twice, parted in four ways."""
    n = F.col("l_linenumber") % 4
    item = F.when(n == 0, F.concat(F.lit("the "), "p_name")).when(n == 1, F.upper("p_name")).when(n == 2, F.replace("p_name", F.lit(" "), F.lit(" big "))).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    l = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_name", item.alias("item"))
    said = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "item"))), lambda x: x["item"]).alias("items"), F.array_sort(F.collect_set("p_name")).alias("members"))
    parted = pick(F.col("l_orderkey"), ", ", " and ", "; ", "\n- ")
    answer = F.array_join(F.transform("items", lambda x: x), "\u0001")
    said = said.withColumn("a", F.concat(F.when(F.col("l_orderkey") % 4 == 3, "- ").otherwise(""), F.replace(answer, F.lit("\u0001"), parted)))
    r = said.select("l_orderkey", N.set_match("a", "members").alias("r"), F.size(T.split_set("a")).cast("bigint").alias("n_items"))
    return rounded(r.select("l_orderkey", "r.precision", "r.recall", "r.exact", "n_items"))


@register(f"""with x as (select c_custkey, n_name a, 'NATION_' || (c_nationkey * 7 + 3) % 25 b, 'NATION_' || c_custkey % 25 c from customer join nation on n_nationkey = c_nationkey),
y as (select *, case c_custkey % 4 when 0 then 'Maybe ' || b || ', or ' || a || '!' when 1 then a || ' (not the ' || b || ')' when 2 then c || ' and ' || a else 'the ' || c end p, case when c_custkey % 3 = 0 then [b, c] else [a, b, c] end e from x),
z as (select *, ' ' || array_to_string({NORM_SQL.format('p')}, ' ') || ' ' t, ' ' || lower(replace(a, '_', '')) || ' ' g, list_transform(e, lambda v: ' ' || lower(replace(v, '_', '')) || ' ') f from y),
w as (select *, case when list_contains(f, g) then list_filter(f, lambda v: v <> g) else [] end r from z)
select c_custkey, (strpos(t, g) > 0 and len(list_filter(r, lambda v: strpos(t, v) between 1 and strpos(t, g) - 1)) = 0)::int::double matched, len(r) n_rivals from w""")
def rival_mentions(spark, sf):
    """Answers that name the gold nation before, after or without other candidates of the question, which may not hold the gold at all."""
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k, name = F.col("c_custkey"), lambda n: F.concat(F.lit("NATION_"), (n % 25).cast("string"))
    x = c.select(k, F.col("n_name").alias("a"), name(F.col("c_nationkey") * 7 + 3).alias("b"), name(k).alias("c"))
    said = F.when(k % 4 == 0, F.concat(F.lit("Maybe "), "b", F.lit(", or "), "a", F.lit("!"))).when(k % 4 == 1, F.concat("a", F.lit(" (not the "), "b", F.lit(")"))).when(k % 4 == 2, F.concat_ws(" and ", "c", "a")).otherwise(F.concat(F.lit("the "), "c"))
    x = x.withColumns({"p": said, "r": T.rivals(F.array("a"), F.when(k % 3 == 0, F.array("b", "c")).otherwise(F.array("a", "b", "c")))})
    return x.select("c_custkey", T.entity_match("p", "a", F.col("r")).alias("matched"), F.size("r").cast("bigint").alias("n_rivals"))


@register("""select s_suppkey, (case s_suppkey % 3 when 0 then 1.0 when 1 then 0.0 else 1.0 end)::double matched, case when s_suppkey % 3 = 2 then '' else 'rival land' end rivals, case s_suppkey % 3 when 0 then 0 when 1 then 4 else 0 end place from supplier""")
def rival_entities(spark, sf):
    """A gold that a rival precedes doesn't match; a rival that isn't of the question is none."""
    n = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    m, gold = F.col("s_suppkey") % 3, F.col("n_name")
    rivals = T.rivals(F.array(gold), F.when(m == 2, F.array(F.lit("Rival Land"))).otherwise(F.array(F.lit("The Rival Land"), gold)))
    answer = F.when(m == 1, F.concat(F.lit("rival land rather than "), gold)).otherwise(F.concat(gold, F.lit(" and not the rival land")))
    return n.select("s_suppkey", T.entity_match(answer, gold, rivals).alias("matched"), F.array_join(rivals, "|").alias("rivals"), T.span_index(T.tokens(answer), T.tokens(gold)).alias("place"))


@register("""select event_id, event_id % 6 kind, case when event_id % 6 = 2 and event_id % 4 = 0 then 'hallucination' when event_id % 6 = 5 then 'hallucination' else 'correct' end outcome,
(case event_id % 6 when 0 then 0.0 else 0.0 end)::double em, round((case event_id % 6 when 0 then 0.5 when 2 then case when event_id % 4 = 0 then 0.0 else 1.0 end when 4 then 0.5 when 5 then 1.0 / 3 else 1.0 end)::double, 6) f1,
round((case event_id % 6 when 2 then case when event_id % 4 = 0 then 0.0 else 1.0 end when 4 then 0.5 when 5 then 1.0 / 3 else 1.0 end)::double, 6) score, event_id % 6 = 4 set_answer from events""")
def scored_kinds(spark, sf):
    """Six kinds of answers through the whole dispatcher: contained entity, number, boolean, date, set, and an entity after its rival."""
    m, kind = F.col("event_id") % 6, F.col("event_type")
    v = F.round("value").cast("int").cast("string")
    answer = (
        F.when(m == 0, F.concat(F.lit("The answer is "), kind)).when(m == 1, F.concat(F.lit("It is "), v)).when(m == 2, "Yes, it is").when(m == 3, F.concat(F.lit("On "), F.date_format("ts", "MMMM d, yyyy")))
        .when(m == 4, F.concat(kind, F.lit(" and three unrelated words"))).otherwise(F.concat(F.lit("rival x rather than "), kind)))
    gold = F.when(m == 1, v).when(m == 2, F.when(F.col("event_id") % 4 == 0, "No").otherwise("Yes")).when(m == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise(kind)
    none = F.array().cast("array<string>")
    rows = t(spark, sf, "events").select(
        "event_id", answer.alias("answer"), F.array(gold).alias("forms"), F.when(m == 4, F.array(kind, F.lit("other thing"))).otherwise(none).alias("members"),
        F.when(m == 5, F.array(kind, F.lit("rival x"))).otherwise(none).alias("question_entities"), pick(m, "entity", "numerical", "boolean", "date", "entity", "entity").alias("answer_type"), F.lit("stop").alias("finish_reason"))
    return rounded(G.scored(rows).select("event_id", (F.col("event_id") % 6).alias("kind"), "outcome", "em", "f1", "score", "set_answer"))


COVERAGE_SQL = SCORES_SQL + """, c as (select question_id, config, outcome, complexity, answer_type, case when answer_type = 'boolean' then null when question_id % 3 = 0 then true when answer_type = 'date' and question_id % 3 = 1 then true else false end present, 4 + question_id % 3 words from scores) """


def coverage(spark, sf) -> DataFrame:
    s, k = scores(spark, sf), F.col("question_id")
    context = F.concat(F.when(k % 3 == 0, F.lit("the gold form ")).when(k % 3 == 1, F.lit("of 1999 it's ")).otherwise(F.lit("nothing like it ")), F.repeat(F.lit("word "), (F.pmod(k, F.lit(3)) + 1).cast("int")))
    results = s.select("question_id", "config", context.alias("context"), (F.pmod(k, F.lit(3)) + 4).cast("int").alias("context_words"))
    golds = s.select("question_id", F.when(F.col("answer_type") == "date", F.array(F.lit("Gold form"), F.lit("1999-05-05"))).otherwise(F.array(F.lit("Gold Form!"))).alias("forms"), "answer_type").distinct()
    return G.enriched(s, results, golds)


@register(COVERAGE_SQL + "select question_id, config, present, words::int context_words from c")
def context_coverage(spark, sf):
    """Scores joined to contexts and golds: whether a gold form, or a date's year, stands in the context."""
    return coverage(spark, sf).select("question_id", "config", "present", "context_words")


@register(COVERAGE_SQL + """, e as (select * from c where present is not null)
select config, 'all' axis, null "value", count(*) eligible, count(*) filter (present) detected, quantile_cont(words::double, 0.5) median_words from e group by 1 union all
select config, 'outcome', outcome, count(*), count(*) filter (present), quantile_cont(words::double, 0.5) from e group by 1, 3 union all
select config, 'complexity', complexity, count(*), count(*) filter (present), quantile_cont(words::double, 0.5) from e group by 1, 3 union all
select config, 'answer_type', answer_type, count(*), count(*) filter (present), quantile_cont(words::double, 0.5) from e group by 1, 3""")
def presence_table(spark, sf):
    return G.presence_table(coverage(spark, sf))


@register("""select s_suppkey, n_name subject, 'label' property, s_name "value" from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 3 <> 0""")
def parsed_lines(spark, sf):
    """Rendered statements read back; what isn't one is dropped."""
    n = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit("["), "n_name", F.lit("] label: "), "s_name", F.lit(" (since: 1990)")))
    return n.select("s_suppkey", T.parse_line(line).alias("p")).where("p is not null").select("s_suppkey", "p.*")


@register("select s_nationkey id, 2 * count(*) parsed, count(*) self_lines, 0 repeats from supplier group by 1")
def context_noise(spark, sf):
    """Lines of contexts that parse, and those that say that a thing is itself."""
    s = t(spark, sf, "supplier")
    line = F.concat(F.lit("- ["), "s_name", F.lit("] same as: "), F.lower("s_name"), F.lit("\n- ["), "s_name", F.lit("] number: "), text("s_suppkey"), F.lit("\nnoise"))
    c = s.groupBy(F.col("s_nationkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("c"))
    return A.context_noise(c, "id", "c").select("id", "parsed", "self_lines", F.col("repeats").cast("int").alias("repeats"))


@register("select conv_id, turn, trim(case turn % 2 when 0 then 'Yes ' else '' end || case when turn % 3 = 0 then '' else 'No' end) said from conversations")
def reasoning_strip(spark, sf):
    """Answers without their reasoning, closed or cut off."""
    k = F.col("turn")
    a = F.concat(F.lit("<think>"), "text", F.lit("</think>"), F.when(k % 2 == 0, "Yes ").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("<THINK>"), "text")).otherwise("No"))
    return t(spark, sf, "conversations").select("conv_id", "turn", T.strip_reasoning(F.regexp_replace(a, "(?<=.)<think>(?=.*</think>.*</think>)", "")).alias("said"))


@register("""select doc_id, case when quality + toxic = 2 then 'full' when quality + toxic = 0 then 'zero' else 'partial' end band, case when doc_id % 3 = 0 then null else (quality + toxic) / 2.0 end::double human from labels""")
def score_bands(spark, sf):
    """Bands of scores, and human scores of claims, null until all are annotated."""
    s = (F.col("quality") + F.col("toxic")) / 2.0
    claim = lambda ok, v: F.struct(v.alias("valid"), ok.alias("supported"))
    claims = F.array(claim(F.col("quality") == 1, F.lit(True)), claim(F.col("toxic") == 1, F.lit(True)), claim(F.lit(None).cast("boolean"), F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("boolean")).otherwise(False)))
    return t(spark, sf, "labels").select("doc_id", T.score_band(s).alias("band"), T.human_score(claims).alias("human"))


@register("""select event_id, case event_id % 4 when 0 then null when 1 then event_id % 8 = 1 when 2 then event_id % 8 = 2 else event_id % 8 = 3 end plausible from events""")
def type_plausible(spark, sf):
    """Whether an answer holds a boolean, a date or a number at all."""
    e, k = t(spark, sf, "events"), F.col("event_id")
    right = k % 8 < 4
    a = F.when(k % 4 == 1, F.when(right, "it is true").otherwise("perhaps")).when(k % 4 == 2, F.when(right, "in 1987").otherwise("long ago")).when(k % 4 == 3, F.when(right, "seven of them").otherwise("many")).otherwise("Paris")
    return e.select("event_id", A.type_plausible(a, pick(k, "entity", "boolean", "date", "numerical"), N.numbers(a)).alias("plausible"))


# Tables of runs.


@register("""select source, count(*) n_instrumented, count(*) filter (doc_id % 5 = 0) n_fallback, count(*) filter (doc_id % 7 = 0) n_empty_pool, list_sort(list(n_chars))[1 + count(*) // 2] median_words from documents group by 1""")
def condense_stats(spark, sf):
    d = t(spark, sf, "documents").withColumn("condense_fallback", F.col("doc_id") % 5 == 0).withColumn("pool_size", F.col("doc_id") % 7).withColumn("condense_words", F.col("n_chars"))
    return A.condense_stats(d, "source")


@register(SCORES_SQL + """, f as (select *, question_id % 9 = 0 failed from scores) select config, count(*) "rows", count(*) filter (failed) errors, count(*) filter (not failed) graded,
round(100 * avg((outcome = 'correct')::int) filter (not failed), 6) pct_correct, round(100 * avg((outcome = 'hallucination')::int) filter (not failed), 6) pct_hallucination, count(*) filter (not failed and question_id % 4 = 0) truncated, true "partition" from f group by 1""")
def arm_summary(spark, sf):
    s = scores(spark, sf).withColumn("failed", F.col("question_id") % 9 == 0).withColumn("finish_reason", F.when(F.col("question_id") % 4 == 0, "length").otherwise("stop"))
    return rounded(A.arm_summary(s, "config").drop("pct_abstention", "pct_other"))


@register("""select event_type, quantile_cont(value, 0.5) median_pool, quantile_cont(event_id::double, 0.5) median_rank, quantile_cont(value + event_id, 0.5) median_total, round(avg(value + event_id), 4) mean_total from events group by 1""")
def latency_medians(spark, sf):
    e = t(spark, sf, "events").select("event_type", F.col("value").alias("pool"), F.col("event_id").cast("double").alias("rank"))
    return rounded(A.latency(e, "event_type", ("pool", "rank")), 9).withColumn("mean_total", F.round("mean_total", 4))


@register("""with c as (select doc_id, quality::double human, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then quality::double else 0.5 end judge from labels)
select count(*) n, round(avg((abs(human - judge) < 0.005)::int), 6) exact_share, round(avg(abs(human - judge)), 6) mean_abs_difference, count(*) n_rejected_claims, count(*) filter (doc_id % 3 = 0) n_incomplete from c where judge is not null""")
def judge_agreement(spark, sf):
    """Human against judge scores, with the claims that were rejected and the decompositions that miss some."""
    k = F.col("doc_id")
    rows = t(spark, sf, "labels").withColumn("config", F.lit("rag")).withColumn("id", k)
    cases = rows.select("config", "id", F.col("quality").cast("double").alias("human"), F.array(F.struct(F.lit(False).alias("valid"))).alias("claims"), (k % 3 != 0).alias("complete"))
    j = rows.select("config", "id", F.when(k % 4 == 1, F.col("quality").cast("double")).when(k % 4 != 0, 0.5).alias("score"))
    return rounded(A.judge_agreement(cases, j))


@register("select s_suppkey::varchar \"key\", case when s_suppkey % 3 = 0 then 'forward,reverse' else 'reverse' end directions from supplier where s_suppkey % 3 < 2")
def truncated_keys(spark, sf):
    m = F.col("s_suppkey") % 3
    s = t(spark, sf, "supplier").select(text("s_suppkey").alias("key"), F.create_map(F.lit("forward"), m == 0, F.lit("reverse"), m < 2).alias("t"))
    return A.truncated_keys(s, "key", "t").select("key", F.array_join("directions", ",").alias("directions"))


@register("select count(*) calls, sum(event_id)::bigint prompt_tokens, sum(user_id)::bigint completion_tokens, round(sum(event_id) / 1e6 * 3 + sum(user_id) / 1e6 * 15, 6) as \"cost\" from events")
def usage_totals(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_id").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    return rounded(A.usage_cost(e, 3.0, 15.0))


@register("select o_orderstatus metric, sum(o_orderkey)::double \"value\", case when o_orderstatus = 'F' then sum(o_orderkey) + 1 else sum(o_orderkey) end::double stored, o_orderstatus <> 'F' matches from orders group by 1")
def compared_metrics(spark, sf):
    """Metrics beside stored ones, of which one is off."""
    o = t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(F.sum("o_orderkey").cast("double").alias("value"))
    return A.compared(o, o.withColumn("value", F.col("value") + (F.col("metric") == "F").cast("int")), ["metric"]).select("metric", "value", "stored", "matches")


# Tests and sections. The exact test's probability is a sum of binomial terms.

EXACT = "case when n01 + n10 = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(n01, n10) + 1), lambda k: exp(lgamma(n01 + n10 + 1) - lgamma(k + 1) - lgamma(n01 + n10 - k + 1) - (n01 + n10) * ln(2.0))))) end"
AGAINST_SQL = SCORES_SQL + """, b as (select question_id, f1 base_f1, (outcome = 'hallucination')::int base_wrong from scores where config = 'view'),
x as (select s.*, (outcome = 'hallucination')::int wrong, base_f1, base_wrong from scores s join b using (question_id) where s.config <> 'view') """


@register(AGAINST_SQL + f""", g as (select config, count(*) n_pairs, count(*) filter (wrong < base_wrong) n01, count(*) filter (wrong > base_wrong) n10 from x group by 1)
select config, n_pairs, n01, n10, round((n10 - n01) / n_pairs, 6) delta, round({EXACT}, 6) p_value from g""")
def mcnemar_exact(spark, sf):
    return rounded(Q.vs_baseline(scores(spark, sf), "view", "hallucination"))


RECURSIVE_AGAINST_SQL = AGAINST_SQL.replace("with last", "with recursive last", 1)
LIMITS_SQL = "round(ci_low, 6) ci_low, round(ci_high, 6) ci_high, round(i.p_value, 6) bootstrap_p, significant"
LIMITS = ("ci_low", "ci_high", "bootstrap_p", "significant")


@register(RECURSIVE_AGAINST_SQL + f""", d as (select config g, question_id o, (wrong - base_wrong)::double v from x), {draws_sql.paired("d", 400)},
c as (select config, count(*) filter (wrong < base_wrong) n01, count(*) filter (wrong > base_wrong) n10 from x group by 1)
select config, n, round(delta, 6) delta, n01, n10, round({EXACT}, 6) mcnemar_p, {LIMITS_SQL} from c join intervals i on i.g = config""")
def baseline_section(spark, sf):
    """Every config against the baseline, with interval and exact test."""
    return rounded(X.baseline_section(scores(spark, sf), "view", 400).select("config", "n", "delta", "n01", "n10", "mcnemar_p", *LIMITS))


@register(RECURSIVE_AGAINST_SQL + f""", d as (select config g, question_id o, f1 - base_f1 v from x where att), {draws_sql.paired("d", 400)},
m as (select config, round(avg(f1) filter (att), 6) config_f1, round(avg(base_f1) filter (att), 6) base_f1, round(avg(base_f1) filter (not att), 6) base_f1_rest from x group by 1)
select config, n, round(delta, 6) delta, config_f1, base_f1, base_f1_rest, {LIMITS_SQL} from m join intervals i on i.g = config""")
def attempted_section(spark, sf):
    return rounded(X.attempted_section(scores(spark, sf), "view", 400).select("config", "n", "delta", "config_f1", "base_f1", "base_f1_rest", *LIMITS))


@register(SCORES_SQL.replace("with last", "with recursive last", 1) + f""", p as (select a.config a, b.config b, question_id, a.f1 fa, b.f1 fb, (a.outcome = 'hallucination')::int wa, (b.outcome = 'hallucination')::int wb from scores a join scores b using (question_id)
where a.att and b.att and (a.config, b.config) in (('click', 'view'), ('error', 'signup'))),
d as (select a || '-' || b g, question_id o, fa - fb v from p), {draws_sql.paired("d", 400)},
c as (select a, b, avg(fa) f1_a, avg(fb) f1_b, count(*) filter (wa < wb) n01, count(*) filter (wa > wb) n10 from p group by 1, 2)
select a, b, n, round(delta, 6) delta, round(f1_a, 6) f1_a, round(f1_b, 6) f1_b, round({EXACT}, 6) mcnemar_p, {LIMITS_SQL} from c join intervals i on i.g = a || '-' || b""")
def joint_section(spark, sf):
    s = X.joint_section(scores(spark, sf), [("click", "view"), ("error", "signup")], 400)
    return rounded(s.select("a", "b", "n", "delta", "f1_a", "f1_b", "mcnemar_p", *LIMITS))


@register(RECURSIVE_AGAINST_SQL + f""", large as (select * from x qualify count(*) over (partition by config, complexity) >= 20),
d as (select config || '-' || complexity g, question_id o, (wrong - base_wrong)::double v from large), {draws_sql.paired("d", 200)},
c as (select config, complexity, count(*) filter (wrong < base_wrong) n01, count(*) filter (wrong > base_wrong) n10 from large group by 1, 2)
select config, complexity, n, round(delta, 6) delta, round({EXACT}, 6) mcnemar_p, {LIMITS_SQL} from c join intervals i on i.g = config || '-' || complexity""")
def claim_checks(spark, sf):
    """The baseline comparison within each complexity that has rows enough."""
    return rounded(X.claim_checks(scores(spark, sf), "view", "complexity", 200, least_n=20).select("config", "complexity", "n", "delta", "mcnemar_p", *LIMITS))


# Pipelines.


@register("""select n_nationkey question_id, 'Answer the following question as concisely as possible. Refuse if you don''t find the answer and reply exactly: "The answer is not in the context."' || chr(10) || chr(10) || 'Question: Where is ' || n_name || '?' || chr(10) || 'Answer:' prompt,
'The answer is not in the context.' answer, null::varchar error from nation""")
def base_answers(spark, sf):
    """Questions without a context, answered by the offline model."""
    q = t(spark, sf, "nation").select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"))
    return P.base_answers(q).select("question_id", "prompt", "answer", F.col("error.type").alias("error"))


def _lines(spark, sf) -> tuple[DataFrame, DataFrame]:
    n = t(spark, sf, "nation")
    q = n.select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("Which supplier is of "), "n_name", F.lit("?")).alias("question"), F.array(text("n_nationkey")).alias("qids"), F.array("n_name").alias("entity_names"))
    first = t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("s_name"))
    return q, first.select(text("s_nationkey").alias("qid"), F.lit(0).alias("line_pos"), F.concat(F.lit("["), "s_name", F.lit("] nation: "), text("s_nationkey")).alias("line"))


ANSWERED_SQL = "with s as (select s_nationkey k, min(s_name) s from supplier group by 1), x as (select n_nationkey question_id, n_name, case when s is not null then '[' || s || '] nation: ' || k end line from nation left join s on k = n_nationkey) "


@register(ANSWERED_SQL + "select question_id, coalesce(line, 'The answer is not in the context.') answer, (line is not null)::int n_lines from x")
def text_rag(spark, sf):
    """One line for each nation: the pool is ranked, joined and answered from."""
    return P.rag_answers(*_lines(spark, sf), k=5).select("question_id", "answer", F.size("top_lines").alias("n_lines"))


@register(ANSWERED_SQL + "select question_id, coalesce(line, 'The answer is not in the context.') answer, false condense_fallback from x")
def condensed_rag(spark, sf):
    """The same by way of a condensation."""
    return P.condensed_answers(*_lines(spark, sf), k=5).select("question_id", F.when(F.col("answer") == T.SENTINEL, F.lit(T.SENTINEL)).otherwise(F.regexp_extract("answer", "(\\[.*)", 1)).alias("answer"), "condense_fallback")


@register(SCORES_SQL + """select question_id, array_to_string(list_transform(list(config order by config) filter (config in ('click', 'view')), lambda x: x), ',') configs, array_to_string(list(outcome order by config) filter (config in ('click', 'view')), ',') answers from scores where config in ('click', 'view') group by 1""")
def wide_answers(spark, sf):
    """Long answers as one row of maps for each question."""
    a = scores(spark, sf).select("question_id", "config", F.col("outcome").alias("answer"), F.lit("c").alias("context"))
    return P.wide(a, ("click", "view")).select("question_id", F.array_join(F.array_sort(F.map_keys("answers")), ",").alias("configs"), F.array_join(F.transform(F.array_sort(F.map_entries("answers")), lambda e: e["value"]), ",").alias("answers"))


@register("select d.doc_id, case when d.doc_id % 2 = 0 then 2 else 3 end n_parts from documents d")
def evidence_parts(spark, sf):
    """Contexts split as a reader sees them: statement lines of graph configs, paragraphs of others."""
    graph = F.lit("Wikidata facts about x:\n- [a] b: c\n- [d] e: f")
    return t(spark, sf, "documents").select("doc_id", F.size(E.evidence_of(F.when(F.col("doc_id") % 2 == 0, "rerank").otherwise("rag"), F.when(F.col("doc_id") % 2 == 0, graph).otherwise("one\n\ntwo\n\n \n\nthree"))).alias("n_parts"))


# Connectors, with services made of the keys they are asked for.


def _article_service(path: str) -> dict | None:
    kind, _, key = path.partition("/")
    k = int(key.rpartition(" ")[2])
    if k % 7 == 3:
        return {"error": "busy"}
    if kind == "title":
        return {"title": None if k % 7 == 5 else f"Supplier {k}"}
    return {"text": "word " * (k % 400)}


@register("""with x as (select s_suppkey k, case when s_suppkey % 2 = 0 then 'cached' when s_suppkey % 7 = 3 then 'unknown' when s_suppkey % 7 = 5 then 'absent' else 'ok' end state, s_suppkey % 400 n from supplier)
select k::varchar "key", state, case state when 'cached' then 2 when 'ok' then case when n = 0 then 0 else 1 + greatest(0, ceil((n - 300) / 250.0)) end else 0 end::bigint n_chunks from x""")
def read_through_chunks(spark, sf):
    """Articles: half are cached, others fetched - absent, unknown or cut into windows."""
    from ..sources import connectors as K

    s = t(spark, sf, "supplier").select(text("s_suppkey").alias("key"), F.col("s_suppkey").alias("k"))
    entry = F.struct(F.lit("t").alias("title"), F.array(F.lit("one"), F.lit("two")).alias("chunks"))
    cached = s.where("k % 2 = 0").select("key", F.lit("ok").alias("state"), entry.alias("entry"))
    chunks, entries, failed = K.read_through_chunks(s, cached, _article_service)
    n = chunks.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    fresh = entries.select(F.col("key").alias("_e"), F.when(F.col("reason") == "no article", "absent").otherwise("ok").alias("s")).unionByName(failed.select(F.col("key").alias("_e"), F.lit("unknown").alias("s")))
    rows = s.join(fresh, F.col("key") == F.col("_e"), "left").join(n, F.col("key") == F.col("_k"), "left")
    return rows.select("key", F.coalesce("s", F.lit("cached")).alias("state"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_chunks"))


@register("""with x as (select s_suppkey k, s_suppkey % 3 m from supplier) select k::varchar "key", case m when 0 then 'cached' when 1 then 'may be cached' else 'incomplete' end state, case m when 0 then 1 else 2 end::bigint n_statements from x""")
def read_through_statements(spark, sf):
    """Statements: a third cached, a third whole, a third without its incoming ones, which may not be cached."""
    from ..sources import connectors as K

    s = t(spark, sf, "supplier").select(text("s_suppkey").alias("key"), (F.col("s_suppkey") % 3).alias("m"))
    statement = lambda n: F.struct(F.concat("key", F.lit(n)).alias("statement_id"), F.lit("Q0").alias("source_entity_id"))
    cached = s.where("m = 0").select("key", F.lit("ok").alias("state"), F.struct(F.array(statement("a")).alias("statements")).alias("entry"))
    row = lambda d, ok, st: s.where("m <> 0").select("key", F.lit(None).cast("string").alias("redirect"), F.lit(d).alias("direction"), ok.alias("succeeded"), st.alias("statement"))
    graph = row("outgoing", F.lit(True), statement("a")).unionByName(row("outgoing", F.lit(True), statement("b"))).unionByName(row("incoming", F.col("m") == 1, F.when(F.lit(False), statement("c"))))
    statements, whole = K.read_through_statements(s, cached, graph)
    n = statements.groupBy(F.col("source_entity_id").alias("_k")).agg(F.count(F.lit(1)).alias("n_statements"))
    w = whole.select(F.col("key").alias("_w"))
    return s.join(n, F.col("key") == F.col("_k")).join(w, F.col("key") == F.col("_w"), "left").select("key", F.when(F.col("m") == 0, "cached").when(F.col("_w").isNotNull(), "may be cached").otherwise("incomplete").alias("state"), "n_statements")


@register("""with r as (select s_suppkey k, s_name, n_name, s_nationkey from supplier join nation on n_nationkey = s_nationkey), b as (select k, 2 * s_nationkey + j st, j from r, range(2) x(j))
select k::varchar subject_id, j::varchar qualifier_id, s_name subject_label, 'nation' property_label, case when s_nationkey % 2 = 0 then n_name else 'n' || s_nationkey end value_label, 'metre' unit, false truncated from r, range(2) x(j)""")
def forward_bindings(spark, sf):
    """Statements of suppliers with two qualifiers each, a value node's unit, and labels by language."""
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    key = text("s_suppkey")
    st = s.select(key.alias("statement_id"), key.alias("subject_id"), F.lit("P1").alias("property_id"), F.concat(F.lit("N"), text("s_nationkey")).alias("value_id"), F.lit("normal").alias("rank"))
    q = s.select(key.alias("statement_id"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("qualifier_id"), F.lit("v").alias("qualifier_value"))
    v = s.select(key.alias("statement_id"), F.lit("metre").alias("unit"), F.lit(9).alias("precision"))
    name = lambda d, i, lang, label: d.select(i.alias("id"), F.lit(lang).alias("lang"), label.alias("label"))
    nation = F.concat(F.lit("N"), text("n_nationkey"))
    labels = name(s, key, "en", F.col("s_name")).unionByName(name(n, nation, "mul", F.concat(F.lit("n"), text("n_nationkey")))).unionByName(name(n.where("n_nationkey % 2 = 0"), nation, "en", F.col("n_name"))).unionByName(name(n, nation, "de", F.lit("x")))
    labels = labels.unionByName(spark.createDataFrame([("P1", "en", "nation")], "id string, lang string, label string"))
    return R.forward_bindings(st, q, v, labels, s.select(key.alias("k")), "k", 10).select("subject_id", "qualifier_id", "subject_label", "property_label", "value_label", "unit", "truncated")


def _judge(prompt: str) -> str:
    """Claims are the answer's words; every second is supported, and one verdict comes only when asked again."""
    from ..operators.faithfulness import DECOMPOSE

    if prompt.startswith(DECOMPOSE):
        if "broken" in prompt:
            raise ValueError("no reply")
        return "\n".join(f"- {w}" for w in prompt.rpartition("\n\n")[2].split())
    n = sum(1 for x in prompt.split("\n") if x[:1].isdigit())
    return "\n".join(f"{i}. {'UNSUPPORTED' if i % 2 else 'SUPPORTED'}" for i in range(1, n + 1) if i != 2 or "missing" in prompt)


@register("""select doc_id, case doc_id % 4 when 0 then 'no_context' when 1 then 'ok' when 2 then 'ok' else 'error' end status, case doc_id % 4 when 1 then 3 when 2 then 1 else 0 end n_claims, round((case doc_id % 4 when 1 then 1.0 / 3 when 2 then 0 end)::double, 6) score, doc_id % 4 = 1 repair_used from labels""")
def judged_answers(spark, sf):
    """Answers through a judge: claims, verdicts, a second question for a missing one, a failed call, and a missing context."""
    from ..operators import faithfulness as J

    m = F.col("doc_id") % 4
    rows = t(spark, sf, "labels").select("doc_id", F.lit("What?").alias("question"), F.when(m == 1, "one two three").when(m == 2, "one").otherwise("broken one").alias("answer"), F.when(m == 0, " ").otherwise("a context").alias("context"))
    return rounded(J.judged(rows, _judge).select("doc_id", "status", "n_claims", "score", "repair_used"))


@register("""select n_nationkey, 'Answer in as few words as possible.' || chr(10) || chr(10) || 'Use the following information to answer the question as concisely as possible. Refuse if you don''t find the answer and reply exactly: "The answer is not in the context."' || chr(10) || chr(10) || n_name || chr(10) || chr(10) || 'Where?' user_text, '' "system" from nation""")
def prompt_variants(spark, sf):
    """A named variant for a model without a system role."""
    n = t(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("context"), F.lit("Where?").alias("question"))
    return P.role_slots(n, "brief", "user").select("n_nationkey", F.col("user").alias("user_text"), "system")


@register("select s_suppkey::varchar \"key\", case when s_suppkey % 3 = 0 then 'failed' else 'ok' end state from supplier where s_suppkey % 2 = 1")
def prewarmed_keys(spark, sf):
    """Keys that aren't cached yet, fetched."""
    from ..sources import connectors as K

    s = t(spark, sf, "supplier").select(text("s_suppkey").alias("key"))
    k = F.col("key").cast("int")
    states = s.select("key", F.when(k % 2 == 0, "ok").otherwise("missing").alias("state"))
    return K.prewarm(s, states, lambda keys: keys.select("key", F.when(k % 3 == 0, "failed").otherwise("ok").alias("state")))


@register(SCORES_SQL + """, c as (select question_id, config, outcome, case config when 'view' then 0 else 1 end pos from scores where config in ('click', 'view') and att)
select question_id, config, 'run ' || question_id question, outcome answer, case when config = 'view' then 'about ' || outcome else 'plain ' || outcome end context from c qualify row_number() over (partition by config order by question_id) <= 40""")
def judge_jobs(spark, sf):
    """Attempted answers of two configs with their contexts, one config's stored as records, at most 40 of each."""
    from ..operators import faithfulness as J

    s = scores(spark, sf)
    stored = F.when(F.col("config") == "view", F.to_json(F.struct(F.concat(F.lit("about "), "outcome").alias("context")))).otherwise(F.concat(F.lit("plain "), "outcome"))
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("config", c.alias("v"))))
    rows = s.groupBy("question_id").agg(entry(F.col("outcome")).alias("answers"), entry(stored).alias("contexts")).withColumn("question", F.concat(F.lit("run "), text("question_id")))
    return J.judge_jobs(s, rows, ("view", "click"), 40).select("question_id", "config", "question", "answer", "context")


@register("select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'a context' else 'another' end context from labels")
def case_contexts(spark, sf):
    """Annotation cases beside the context of their answer: stored as text, as a record, or not at all."""
    from ..operators import faithfulness as J

    lab, k = t(spark, sf, "labels"), F.col("doc_id") % 3
    cases = lab.select("doc_id", F.lit("rag").alias("config"), F.col("doc_id").alias("id"))
    contexts = lab.where("doc_id % 6 <> 0").select(F.lit("rag").alias("config"), F.col("doc_id").alias("id"), F.when(k == 1, "a context").when(k == 2, '{"context": "another", "pool_size": 3}').otherwise('{"pool_size": 0}').alias("captured"))
    return J.with_contexts(cases, contexts).select("doc_id", "context")


# Services, sinks and requests once more.


def _graph_service(query: str) -> dict:
    k = int(query)
    cells = [{"st": {"value": f"{k}-{j}"}, **({"label": {"value": f"n{k}"}} if k % 2 == 0 else {})} for j in range(k % 3)]
    return {"results": {"bindings": cells}}


@register("select n_nationkey k, n_nationkey || '-' || j st, case when n_nationkey % 2 = 0 then 'n' || n_nationkey end \"label\" from nation, range(3) x(j) where j < n_nationkey % 3")
def graph_rows(spark, sf):
    """Rows of a graph service for every key; cells that a row lacks are null."""
    from ..sources import connectors as K

    def fetch(batches):
        for pdf in batches:
            rows = [(k, r["st"], r.get("label")) for k in pdf["k"] for r in K.graph_bindings(_graph_service, str(k), 2)]
            yield type(pdf)(rows, columns=["k", "st", "label"])

    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).mapInPandas(fetch, "k bigint, st string, label string").withColumn("k", F.col("k").cast("int"))


@register(SCORES_SQL + "select count(distinct question_id) n_results, count(*) filter (att) n_judged from scores")
def cross_checked_run(spark, sf):
    """Results, golds and judge records that must agree; any breach would fail."""
    s = scores(spark, sf)
    ids = s.select(text("question_id").alias("id")).distinct()
    own = s.withColumn("question_id", text("question_id"))
    judged_rows = own.where(T.is_attempted("outcome")).select(F.col("question_id").alias("id"), "config", "outcome")
    results = ids.withColumn("errors", F.create_map().cast("map<string,string>"))
    readers.cross_checked(results, ids, judged_rows, tuple(r.config for r in s.select("config").distinct().collect()), own)
    return results.agg(F.count(F.lit(1)).alias("n_results")).crossJoin(F.broadcast(judged_rows.agg(F.count(F.lit(1)).alias("n_judged"))))


@register("select o_orderkey id, o_orderstatus status from orders")
def final_results(spark, sf):
    """Results written in the order of the questions and read again."""
    path = scratch(spark, "results")
    sinks.write_results(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("pos")), path)
    return spark.read.schema("id bigint, status string").json(path)


@register("""select p_partkey, case p_size % 6 when 0 then 'question is missing' when 1 then 'question is longer than 500 characters' when 2 then 'unknown config' when 3 then 'an entity''s key is malformed' when 4 then 'entities must be a list of at most 20' end fault from part""")
def request_faults(spark, sf):
    """Requests with every fault, and without one."""
    from pyspark.sql.functions import pandas_udf

    def bodies(k: int) -> object:
        m, entity = k % 6, {"qid": "Q12"}
        return {"question": " " if m == 0 else "x" * 501 if m == 1 else "Who?", "config": "none" if m == 2 else "rag", "entities": [{"qid": "12"}] if m == 3 else [entity] * (21 if m == 4 else 2)}

    @pandas_udf("string")
    def fault(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda k: C.request_fault(bodies(int(k)), ("rag",)))

    return t(spark, sf, "part").select("p_partkey", fault("p_size").alias("fault"))


def _failing_model(prompt: str) -> str:
    if prompt.endswith("0"):
        raise ValueError("no such model")
    if prompt.endswith("5"):
        raise P.IncompleteRetrieval("503 while fetching")
    return f"said {prompt}"


@register("""select s_suppkey, case when s_suppkey % 5 <> 0 then 'said ' || s_suppkey end answer, case when s_suppkey % 10 = 0 then 'ValueError' when s_suppkey % 5 = 0 then 'IncompleteRetrieval' end error_type, case when s_suppkey % 5 = 0 then 1 else 0 end attempts from supplier""")
def failed_calls(spark, sf):
    """Calls that fail in ways that another attempt can't mend: exactly one of answer and error is set."""
    rows = P.completed(t(spark, sf, "supplier").select("s_suppkey", text("s_suppkey").alias("prompt")), "prompt", _failing_model)
    return rows.select("s_suppkey", "answer", F.col("error.type").alias("error_type"), F.coalesce("error.attempts", F.lit(0)).alias("attempts"))


@register("""with m as (select n_nationkey k, n_name, case when n_nationkey % 5 = 4 then n_nationkey - 1 end r from nation)
select a.k qid, coalesce(b.n_name, a.n_name) "label", case when b.k is not null then 'nation ' || b.k else 'nation ' || a.k end description, coalesce(a.r, -1) redirect from m a left join m b on a.r = b.k""")
def redirected_meta(spark, sf):
    """Names and descriptions of entities, some of which lead to another."""
    n, k = t(spark, sf, "nation"), F.col("n_nationkey")
    rows = n.select(k.alias("qid"), F.col("n_name").alias("label"), F.concat(F.lit("nation "), text("n_nationkey")).alias("description"), F.lower("n_name").alias("alias"), F.when(k % 5 == 4, k - 1).alias("redirect"))
    return R.entity_meta(rows.unionByName(rows)).select("qid", "label", "description", F.coalesce("redirect", F.lit(-1)).alias("redirect"))


@register("""select p_partkey statement_id, case when p_size % 2 = 0 then 1 else 2 end n_qualifiers from part where p_size % 3 <> 0 and p_size % 5 <> 0""")
def unresolved_labels(spark, sf):
    """Statements without a readable property or value go, and so do qualifiers whose property is only a number."""
    p, m = t(spark, sf, "part"), F.col("p_size")
    null = F.lit(None).cast("string")
    value = lambda label: F.struct(F.lit("value").alias("snaktype"), F.lit("String").alias("datatype"), null.alias("id"), label.alias("label"), null.alias("raw"), null.alias("unit"), F.lit(None).cast("int").alias("precision"))
    rows = p.select(
        F.col("p_partkey").alias("statement_id"), F.lit("s").alias("subject_id"), F.col("p_brand").alias("subject_label"), F.lit("P1").alias("property_id"), F.when(m % 3 == 0, "").otherwise("made of").alias("property_label"),
        value(F.when(m % 5 != 0, F.col("p_name"))).alias("value"), F.lit("normal").alias("rank"), F.lit("outgoing").alias("direction"), F.lit("s").alias("source_entity_id"),
        F.explode(F.array(
            F.struct(F.lit("P2").alias("property_id"), F.lit("colour").alias("property_label"), value(F.lit("red")).alias("value")),
            F.struct(F.lit("P3").alias("property_id"), F.when(m % 2 == 0, "P3").otherwise("size").alias("property_label"), value(F.lit("big")).alias("value")))).alias("qualifier"))
    return R.fold_statements(rows).select("statement_id", F.size("qualifiers").alias("n_qualifiers"))


@register("""select o_orderkey, case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m') when 2 then year(o_orderdate)::varchar when 3 then year(o_orderdate) || 's' when 4 then 'circa ' || year(o_orderdate) else '-' || strftime(o_orderdate, '%Y-%m') end shown from orders""")
def tidy_times(spark, sf):
    """Times as far as their precision goes: day, month, year, decade, less, and a month before our era."""
    k = F.col("o_orderkey") % 6
    written = F.concat(F.when(k == 5, "-").otherwise("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return t(spark, sf, "orders").select("o_orderkey", S.tidy_time(written, F.element_at(F.array(*[F.lit(p) for p in (11, 10, 9, 8, 7, 10)]), (k + 1).cast("int"))).alias("shown"))
