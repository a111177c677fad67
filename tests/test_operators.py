"""Operators on small inline tables: the designed cohort, statistics, retrieval, statements, sources, pipelines, streaming."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrove.functions import statements as S
from veritrove.functions.text import OUTCOMES
from veritrove.operators import aggregate as A
from veritrove.operators import faithfulness as J
from veritrove.operators import retrieval as R
from veritrove.operators import scoring as C
from veritrove.operators import stats as Q
from veritrove.plans import pipelines as P
from veritrove.sources import readers, sinks
from veritrove.streaming import outcomes as stream

#: Eight questions, four configs, outcomes by letter.
DESIGN = {"C1": "CHCHCCHC", "C2": "CACACHAC", "C3": "CCAAOHCA", "C4": "HCCACHHC"}
LETTER = {o[0].upper(): o for o in OUTCOMES}


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(f"q{i + 1}", c, LETTER[x], 1.0 if x == "C" else 0.0) for c, s in DESIGN.items() for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "question_id string, config string, outcome string, f1 double").withColumn("em", F.col("f1")).withColumn("score", F.col("f1")).cache()


def test_outcomes(scores):
    got = {r.config: (r.n_attempted, r.n_hallucination) for r in A.outcomes(scores).collect()}
    assert got == {"C1": (8, 3), "C2": (5, 1), "C3": (4, 1), "C4": (7, 3)}
    only = A.outcomes(scores.where("outcome = 'abstention'")).first()
    assert only.correct_rate_attempted is None and only.f1_attempted == 0.0
    assert all(r.holds for r in A.f1_identity(A.outcomes(scores)).collect())
    with pytest.raises(Exception, match="unknown outcome"):
        A.outcomes(scores.withColumn("outcome", F.lit("maybe"))).collect()


def test_cohorts_and_pairs(scores):
    c = {}
    for r in A.cohorts(scores, configs=tuple(DESIGN)).collect():
        c.setdefault(r.cohort, set()).add(r.question_id)
    assert c["common_attempted:all"] == {"q1", "q6"}
    assert c["common_attempted:C1+C2"] == {"q1", "q3", "q5", "q6", "q8"}
    p = A.pair_attempted(scores, "C1", "C2").first()
    assert (p.n_common, p.both_hallucinate, p.a_only, p.b_only, p.neither) == (5, 0, 0, 1, 4)
    t = {(r.b_outcome, r.a_outcome): r["count"] for r in A.transitions(scores, "C1", "C2").collect()}
    assert len(t) == 16 and t["abstention", "hallucination"] == 3 and sum(t.values()) == 8
    assert {r.pattern: r.n_questions for r in A.attempt_patterns(scores).collect()}["C1+C2+C3+C4"] == 2
    assert A.n_dropped(scores.where("not (config = 'C1' and question_id = 'q1')"), "C1", "C2").first().n_dropped == 1


@pytest.mark.parametrize("n01,n10,p", [(0, 0, 1.0), (0, 5, 0.0625), (1, 9, 0.021484375), (5, 5, 1.0), (3, 3, 1.0)])
def test_mcnemar(n01, n10, p):
    assert Q.mcnemar_p(n01, n10) == p


def test_stats_frames(spark, scores):
    r = Q.compare_configs(scores, "C1", "C2", F.col("f1"), resamples=200).first()
    assert r.n == 8 and r.ci_low <= r.delta <= r.ci_high
    m = {x.config: (x.n01, x.n10) for x in Q.vs_baseline(scores, "C1", "hallucination").collect()}
    assert m["C2"] == (3, 1)
    with pytest.raises(Exception, match="binary"):
        Q.mcnemar(scores, F.col("f1") + 0.5, F.col("f1")).collect()
    s = Q.stratified_sample(spark.range(100).withColumn("g", F.col("id") % 3), "g", "id", 10, exclude=spark.range(5))
    assert s.count() == 10 and s.where("id < 5").isEmpty()
    assert Q.poisson_bootstrap(Q.deltas(scores, "C1", "C2", F.col("f1")), "delta", "question_id", 50).first().n == 8


def ranked(spark, rows, f, k):
    df = spark.createDataFrame(rows, "pos int, g string, s double")
    return [r.pos for r in f(R.zscores(df, "s", [], "g"), k).orderBy("rank").collect()]


def test_ranking(spark):
    rows = [(0, "a", 0.9), (1, "a", 0.8), (2, "a", 0.7), (3, "b", 0.2), (4, "b", 0.1), (5, "c", 0.3)]
    assert ranked(spark, rows, lambda z, k: R.topk(z, "z", [], "pos", k), 2) == [0, 3]
    assert set(ranked(spark, rows, lambda z, k: R.floor_topk(z, "z", [], "g", "pos", k), 3)) == {0, 3, 5}
    assert len(ranked(spark, rows, lambda z, k: R.floor_topk(z, "z", [], "g", "pos", k), 10)) == 6


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (300, 1), (301, 2), (550, 2), (551, 3), (800, 3)])
def test_windows(spark, n, expected):
    text = "  ".join(f"w{i}" for i in range(n))
    w = spark.range(1).select(R.windows(F.lit(text)).alias("w")).first().w
    assert len(w) == expected and (not w or w[-1].split()[-1] == f"w{n - 1}")


def snak(label, kind="WikibaseItem", snaktype="value"):
    return (snaktype, kind, None, label, None, None, None)


def test_statements(spark):
    schema = ("statement_id string, subject_id string, subject_label string, property_id string, property_label string, "
              "value struct<snaktype:string,datatype:string,id:string,label:string,raw:string,unit:string,precision:int>, rank string, direction string, source_entity_id string, "
              "qualifier struct<property_id:string,property_label:string,value:struct<snaktype:string,datatype:string,id:string,label:string,raw:string,unit:string,precision:int>>")
    row = lambda st, prop, value, qual=None, rank="normal", direction="outgoing": (st, "Q1", "Tom", "P1", prop, value, rank, direction, "Q1", qual)
    rows = [row("s1", "award", snak("Oscar"), ("P2", "year", snak("1994"))), row("s1", "award", snak("Oscar"), ("P1", "for", snak("Philadelphia"))), row("s1", "award", snak("Oscar"), ("P3", "P3", snak("x"))),
            row("s2", "award", snak("Oscar"), ("P2", "year", snak("1995"))), row("s3", "award", snak(None)), row("s4", "child", snak(None, snaktype="somevalue")),
            row("s5", "ISNI", snak("123", "ExternalId")), row("s6", "award", snak("Old"), rank="deprecated")]
    rows += [row(f"t{i:02}", "member of", snak("Tom"), direction="incoming") for i in range(40)]
    folded = R.fold_statements(spark.createDataFrame(rows, schema))
    clean = R.clean_statements(folded)
    lines = sorted(r.v for r in clean.where("direction = 'outgoing'").select(S.render_statement(F.col("subject_label"), F.col("property_label"), F.col("value"), F.col("qualifiers")).alias("v")).collect())
    assert lines == ["[Tom] award: Oscar (for: Philadelphia; year: 1994)", "[Tom] award: Oscar (year: 1995)", "[Tom] child: (unknown value)"]
    assert clean.where("direction = 'incoming'").count() == 30


def test_scoring(spark):
    rows = [("Paris it is", ["Paris"], [], "entity", "correct"), ("London", ["Paris"], [], "entity", "hallucination"), ("2 million", ["2000000", "$2 million"], [], "numerical", "correct"),
            ("Matt Damon", ["x"], ["Matt Damon", "Ben Affleck"], "entity", "correct"), ("The answer is not in the context.", ["Paris"], [], "entity", "abstention"), (None, ["Paris"], [], "entity", "other"),
            ("No, it did not", ["No"], [], "boolean", "correct"), ("March 13, 2007", ["13-Mar-07", "2007-03-13"], [], "date", "correct")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, answer string, forms array<string>, members array<string>, answer_type string, expected string")
    got = C.scored(df.withColumn("question_entities", F.array().cast("array<string>")).withColumn("finish_reason", F.lit(None).cast("string"))).orderBy("i").collect()
    assert [r.outcome for r in got] == [r.expected for r in got]
    assert got[3].set_answer and got[3].recall == 0.5 and got[4].f1 == 0.0


def test_unpivot(spark):
    rows = [("a", {"rag": "x", "odd": "y"}, {"rag": "one two"}, {}, {}, {}), ("b", {"rag": "ERROR: down", "rerank": "z"}, None, {"rerank": 7}, {}, None), ("c", {}, {}, {}, {}, {"graph_rag": "boom"})]
    df = spark.createDataFrame(rows, "id string, answers map<string,string>, contexts map<string,string>, context_words map<string,int>, finish_reasons map<string,string>, errors map<string,string>")
    long = C.unpivot_answers(df)
    assert {(r.id, r.config, r.failed, r.context_words) for r in long.collect()} == {("a", "rag", False, 2), ("b", "rag", True, None), ("b", "rerank", False, 7), ("c", "graph_rag", True, None)}
    assert {r.id for r in C.without_failures(long).collect()} == {"a"} and C.without_failures(long, per_config=True).count() == 2


def test_faithfulness(spark):
    rows = [("a", "ctx", "- one\n- **two**", "1. SUPPORTED\n2. UNSUPPORTED", None), ("a", "ctx", "just one line", "1) supported", None), ("a", "", "- x", "1. SUPPORTED", None), ("", "ctx", "- x", "", None),
            ("a", "ctx", "", "", None), ("a", "ctx", "- x\n- y", "1. SUPPORTED\n1. UNSUPPORTED\n2. SUPPORTED\n9. SUPPORTED", None), ("a", "ctx", "- x\n- y", "2. SUPPORTED", "1. UNSUPPORTED\n2. UNSUPPORTED")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, answer string, context string, raw_claims string, raw_verdicts string, raw_repair string")
    got = J.scored(df).orderBy("i").collect()
    assert [r.status for r in got] == ["ok", "ok", "no_context", "no_answer", "no_claims", "unparsed_verdicts", "ok"]
    assert [r.score for r in got] == [0.5, 1.0, None, None, None, None, 0.5] and got[0].claims == ["one", "two"] and got[5].partial_score == 1.0
    assert df.where("i = 5").select(J.out_of_range("raw_verdicts", F.lit(2)).alias("o")).first().o == [9]


def test_sources(spark, tmp_path):
    q = [{"id": "q1", "question": "?", "questionEntity": [], "answer": {"answerType": "boolean", "answer": [True], "mention": "Yes"}}, {"id": "q2", "question": "??", "questionEntity": [], "answer": {}}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    (tmp_path / "ids.json").write_text(json.dumps(["q2", {"id": "q1"}, {"no": 1}]))
    (tmp_path / "bad.json").write_text(json.dumps([{"id": "x"}]))
    (tmp_path / "none.json").write_text("")
    read = readers.read_questions(spark, str(tmp_path / "q.json"))
    assert [r.id for r in read.orderBy("pos").collect()] == ["q1", "q2"] and '"boolean"' in read.where("id = 'q1'").first().answer
    assert {r.id for r in readers.read_ids(spark, str(tmp_path / "ids.json")).collect()} == {"q1", "q2"}
    assert readers.read_questions(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(readers.NotQuestions):
        readers.read_questions(spark, str(tmp_path / "bad.json"))
    assert readers.covering(read.select("id"), {"half": read.where("id = 'q1'"), "whole": read}) == "whole"
    cache = tmp_path / "cache"
    cache.mkdir()
    for key, text in {"Q1": json.dumps({"v": 8, "query_succeeded": {"label": True}, "statements": []}), "Q2": "{nope", "Q3": json.dumps({"v": 7, "query_succeeded": {"label": True}, "statements": []}),
                      "Q4": json.dumps({"v": 8, "query_succeeded": {"label": False}, "statements": []}), "Q5": json.dumps([1])}.items():
        (cache / f"{key}.json").write_text(text)
    states = readers.statement_cache(spark, str(cache))
    wanted = spark.createDataFrame([(f"Q{i}",) for i in range(1, 7)], "key string")
    assert {r.key: r.state for r in readers.with_missing(states.select("key", "state"), wanted).collect()} == {"Q1": "ok", "Q2": "malformed", "Q3": "stale", "Q4": "incomplete", "Q5": "malformed", "Q6": "missing"}
    articles = tmp_path / "articles"
    articles.mkdir()
    for key, value in {"Q1": {"v": 1, "fetch_succeeded": True, "chunks": ["a", "b"], "title": "T"}, "Q2": ["old"], "Q3": {"v": 1, "fetch_succeeded": False, "chunks": []}, "Q4": {"v": 1, "fetch_succeeded": True, "chunks": []}}.items():
        (articles / f"{key}.json").write_text(json.dumps(value))
    a = readers.article_cache(spark, str(articles))
    assert {r.key: r.state for r in a.collect()} == {"Q1": "ok", "Q2": "stale", "Q3": "failed", "Q4": "ok"}
    assert [(r["index"], r.text, r.n_chunks) for r in readers.cached_chunks(a).orderBy("index").collect()] == [(0, "a", 2), (1, "b", 2)]


def test_sinks(spark, tmp_path):
    q = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos int")
    done = spark.createDataFrame([("b", "x")], "id string, answer string")
    assert {r.id for r in sinks.resume(q, done).collect()} == {"a", "c"}
    fresh = spark.createDataFrame([("a", "y"), ("c", "z")], "id string, answer string")
    assert [r.answer for r in sinks.finished(q, done, fresh).collect()] == ["y", "x", "z"]
    with pytest.raises(ValueError):
        sinks.resume(q, done.unionByName(done))
    assert sinks.fmt_p(0.0) == "<.001" and "| b | x |" in sinks.markdown(done)
    assert {r.id: r.answer for r in sinks.overlay(done, fresh.unionByName(spark.createDataFrame([("b", "d")], "id string, answer string")), "id", "answer").collect()} == {"a": "y", "b": "x", "c": "z"}


def test_pipelines(spark):
    q = spark.createDataFrame([(1, "Where is Alpha?", ["Q1"], ["Alpha"]), (2, "And nothing?", ["Q9"], ["None"])], "question_id int, question string, qids array<string>, entity_names array<string>")
    lines = spark.createDataFrame([("Q1", 0, "[Alpha] located in: Beta"), ("Q1", 1, "[Alpha] kind: town"), ("Q1", 2, "[Alpha] kind: town")], "qid string, line_pos int, line string")
    got = {r.question_id: r for r in P.rag_answers(q, lines, k=5, facts=True).collect()}
    assert got[1].answer.startswith("[Alpha]") and len(got[1].top_lines) == 2 and got[2].answer == P.SENTINEL
    assert {r.question_id: r.condense_fallback for r in P.condensed_answers(q, lines).collect()} == {1: False, 2: False}
    assert P.base_answers(q).where(F.col("answer") == P.SENTINEL).count() == 2
    tries = []

    def flaky(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise RuntimeError("503 overloaded")
        return "ok"

    assert P.attempt(flaky, "p", sleep=lambda s: None) == ("ok", None)
    assert P.attempt(lambda p: (_ for _ in ()).throw(P.IncompleteRetrieval("503")), "p", sleep=lambda s: None)[1]["attempts"] == 1


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "rag", "correct"), (2, "rag", "other")], "id int, config string, outcome string").write.parquet(src)
    s = spark.readStream.schema("id int, config string, outcome string").parquet(src)
    stream.run(s, out, str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
    assert stream.counted(s.withColumn("ts", F.current_timestamp())).isStreaming


def join_rows(df) -> int:
    """Rows that the joins of a query that has run have made."""

    def nodes(plan):
        yield plan
        below = plan.children()
        inner = [plan.executedPlan()] if "AdaptiveSparkPlan" in plan.nodeName() else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        for p in [*(below.apply(i) for i in range(below.size())), *inner]:
            yield from nodes(p)

    return sum(p.metrics().apply("numOutputRows").value() for p in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName())


def test_pool_of_repeated_lines(spark):
    """Equal lines, of one key or several, come to a question once, as the first; copies aren't fanned out."""
    r = random.Random(5)
    asked = [(q, [r.choice("abcdef") for _ in range(r.randrange(4))]) for q in range(40)] + [(40, None), (None, ["a", "b"]), (7, ["e", "a"])]
    texts = [(r.choice("abcdef"), k, r.choice(["x", "y", "z", "a1", "b2", None])) for k in range(90)] + [(None, 90, "x")] + [("f", 91 + k, "only f") for k in range(500)]
    want = {}
    for question, keys in asked:
        for at, key in enumerate(keys or ()):
            for qid, pos, line in texts:
                if qid == key:
                    want[question, line] = min(want.get((question, line), (99, 0, "")), (at, pos, qid))
    got = R.pool(spark.createDataFrame(asked, "question_id int, qids array<string>"), spark.createDataFrame(texts, "qid string, line_pos int, line string"))
    rows = got.collect()
    found = {(g.question_id, g.line): (g.entity_pos, g.line_pos, g.qid) for g in rows}
    # Question 7 has two rows: which of its keys at one place is first isn't said.
    same = {k for k in want if k[0] != 7}
    assert len(rows) == len(want) == len(found) and found.keys() == want.keys() and all(found[k] == want[k] for k in same)
    assert join_rows(got) < 40 * 4 * 7


def test_pool_of_one_key(spark):
    """The fan-out of one key is work of several tasks."""
    key = F.when(F.col("id") >= 0, "k").otherwise("none")  # no constant: that would be a product of all rows
    questions = spark.range(1100).select(F.col("id").alias("question_id"), F.array(key).alias("qids"))
    lines = spark.range(1030).select(key.alias("qid"), F.col("id").alias("line_pos"), F.concat(F.lit("line "), "id").alias("line"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        got = R.pool(questions, lines)
        parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        kept = got.select("question_id", "line").distinct().count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(p.n for p in parts) == kept == 1100 * 1030
    assert max(p.n for p in parts) < 0.8 * kept


@pytest.mark.parametrize("size", [1, 3, 512])
def test_paired(spark, size):
    """Packs of any size give the inner join: keys of one side alone, null keys, equal rows."""
    r = random.Random(size)
    some = lambda own, n: [(r.choice(["a", "b", "c", None, own]), r.choice([k, k, None]), f"v{r.randrange(9)}") for k in range(n)]
    left, right = some("x", 40), some("y", 31)
    want = sorted(((a, i, u, j, v) for a, i, u in left for b, j, v in right if a is not None and a == b), key=repr)
    got = R.paired(spark.createDataFrame(left, "k string, i int, u string"), spark.createDataFrame(right, "k string, j int, v string"), "k", "i", "v", size)
    assert got.columns == ["k", "i", "u", "j", "v"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
