"""Sources, sinks, connectors and sections beyond what queries show."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veritrove.operators import aggregate as A
from veritrove.operators import retrieval as R
from veritrove.operators import sections as X
from veritrove.operators import stats as Q
from veritrove.plans import pipelines as P
from veritrove.sources import connectors as K
from veritrove.sources import readers, sinks


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(q, c, "hallucination" if (q + i) % 3 == 0 else "abstention" if (q + i) % 5 == 0 else "correct", (q * (i + 1) % 7) / 7.0, "easy" if q % 2 else "hard") for q in range(120) for i, c in enumerate("abc")]
    return spark.createDataFrame(rows, "question_id bigint, config string, outcome string, f1 double, complexity string")


def test_sections_are_the_single_tests(scores):
    """Intervals and probabilities of a section are those that each config's own comparison gives."""
    wrong = (F.col("outcome") == "hallucination").cast("double")
    for r in X.baseline_section(scores, "a", 200).collect():
        one = Q.compare_configs(scores, r.config, "a", wrong, 200).first()
        exact = Q.vs_baseline(scores, "a", "hallucination").where(F.col("config") == r.config).first()
        assert (r.n, r.delta, r.ci_low, r.ci_high, r.bootstrap_p) == (one.n, one.delta, one.ci_low, one.ci_high, one.p_value) and r.mcnemar_p == exact.p_value
    tried = scores.where("outcome in ('correct', 'hallucination')")
    joint = X.joint_section(scores, [("b", "c")], 200).first()
    one = Q.compare_configs(tried, "b", "c", F.col("f1"), 200).first()
    assert (joint.n, joint.delta, joint.ci_low, joint.ci_high) == (one.n, one.delta, one.ci_low, one.ci_high)
    inside = {r.config: r for r in X.attempted_section(scores, "a", 200).collect()}
    assert inside["b"].n == tried.where("config = 'b'").count() and inside["b"].delta == pytest.approx(inside["b"].config_f1 - inside["b"].base_f1)
    groups = X.claim_checks(scores, "a", "complexity", 100, least_n=60).collect()
    assert sorted((r.config, r.complexity) for r in groups) == [("b", "easy"), ("b", "hard"), ("c", "easy"), ("c", "hard")] and X.claim_checks(scores, "a", "complexity", 100, least_n=61).count() == 0


def test_floor_topk_by_question(spark):
    rows = [(q, g, i, float((i * 7 + q) % 11)) for q in (1, 2) for g in "xyz" for i in range(5)]
    df = spark.createDataFrame(rows, "q int, g string, i int, v double")
    for question in (["q"], []):
        got = R.floor_topk(df.where("q = 1") if not question else df, "v", question, "g", "i", 7).where("q = 1").collect()
        mine = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1], -r[3], r[2]))
        reserved = [r for k, r in enumerate(mine) if k % 5 < 2]
        rest = sorted((r for r in mine if r not in reserved), key=lambda r: (-r[3], r[2]))
        want = {(r[1], r[2]) for r in reserved + rest[:1]}
        assert {(r.g, r.i) for r in got} == want or {r.v for r in got} == {r[3] for r in reserved + rest[:1]}
        assert sorted(r["rank"] for r in got) == list(range(1, 8))


def test_upper_median_and_digest(spark):
    df = spark.createDataFrame([(g, v) for g, n in (("a", 1), ("b", 2), ("c", 5), ("d", 6)) for v in range(n)] + [("e", None)], "g string, v int")
    assert {r.g: r.m for r in A.exact_median(df, ["g"], "v", "m", upper=True).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": None}
    assert {r.g: r.m for r in A.exact_median(df, ["g"], "v", "m").collect()} == {"a": 0, "b": 0.5, "c": 2, "d": 2.5, "e": None}
    digest = lambda n: hashlib.sha256("\n".join(sorted(map(str, range(n)))).encode()).hexdigest()
    repeated = df.unionByName(df).unionByName(spark.range(2000).select(F.lit("f").alias("g"), F.col("id").cast("int").alias("v")))
    assert {tuple(r) for r in A.membership_hash(repeated, "g", "v").collect()} == {(g, n, digest(n)) for g, n in (("a", 1), ("b", 2), ("c", 5), ("d", 6), ("f", 2000))}


def test_run_lifecycle(spark, tmp_path):
    folder = f"file://{tmp_path}"
    sinks.start_snapshot(spark, folder, {"model": "m"})
    sinks.start_snapshot(spark, folder, {"model": "m"})
    with pytest.raises(ValueError):
        sinks.start_snapshot(spark, folder, {"model": "n"})
    for scorer, n in (("s1", 1), ("s1", 1), ("s2", 2)):
        assert len(sinks.finalise(spark, folder, "h", scorer, {"f1": n})) == n
    with pytest.raises(ValueError):
        sinks.finalise(spark, folder, "other", "s2", {})
    assert sinks.write_reports(spark, folder, {"a.md": "x", "b.md": "y"}, check=True) == ["a.md", "b.md"]
    assert sinks.write_reports(spark, folder, {"a.md": "x", "b.md": "y"}) == ["a.md", "b.md"] and sinks.write_reports(spark, folder, {"a.md": "x", "b.md": "z"}, check=True) == ["b.md"]
    assert json.loads(sinks.json_report(spark.range(2).orderBy("id"))) == [{"id": 0}, {"id": 1}]
    assert sinks.log_call(spark.range(1), f"{folder}/calls") is None and sinks.log_call(spark.range(1), "nosuch://x/y") is not None
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "p.json").write_text('{"id": 1}\n{"id": 2')
    with pytest.raises(Exception, match="torn line"):
        sinks.read_partial(spark, f"{folder}/torn", "id int").collect()
    with pytest.raises(ValueError, match="model"):
        sinks.resumable({"model": "a"}, {"model": "b"})
    assert (sinks.fmt_delta(-0.0123), sinks.fmt_interval(0.1, 0.2), sinks.fmt_small("5.0", 49), sinks.fmt_small("5.0", 50)) == ("-1.2", "[+10.0, +20.0]", "5.0†", "5.0")
    cases = spark.createDataFrame([("c", 1, "yes")], "config string, id int, hand string")
    with pytest.raises(ValueError):
        sinks.merge_annotations(cases, cases, hashes=("a", "b"), filled="hand")
    assert sinks.merge_annotations(cases, cases, hashes=("a", "a"), filled="hand").count() == 1


def test_resolved_source(spark, tmp_path):
    record = lambda i: {"id": i, "question": "q", "questionEntity": [], "answer": {"answerType": "string", "answer": ["x"]}}
    (tmp_path / "raw.json").write_text(json.dumps([{"id": "1"}]))
    (tmp_path / "few.json").write_text(json.dumps([record("1")]))
    (tmp_path / "all.json").write_text(json.dumps([record("1"), record("2")]))
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    at = lambda n: f"file://{tmp_path}/{n}.json"
    path, questions = readers.resolve_source(spark, ids, at("missing"), at("raw"), (at("few"), at("all")))
    assert path == at("all") and [r.id for r in questions.orderBy("pos").collect()] == ["1", "2"]
    with pytest.raises(LookupError, match="tried"):
        readers.resolve_source(spark, ids, at("few"))
    assert readers.only_file(spark, at("fe*")) == f"file:{tmp_path}/few.json"
    with pytest.raises(LookupError):
        readers.only_file(spark, at("*"))


def test_cross_checked_outcomes(spark, scores):
    results = spark.createDataFrame([("1", {}), ("2", {})], "id string, errors map<string,string>")
    golds = results.select("id")
    s = spark.createDataFrame([("1", "a", "correct"), ("2", "a", "abstention")], "question_id string, config string, outcome string")
    j = lambda *rows: spark.createDataFrame(list(rows), "id string, config string, outcome string")
    readers.cross_checked(results, golds, j(("1", "a", "correct")), ("a",), s)
    for bad, what in ((j(("1", "a", "correct"), ("2", "a", "abstention")), "cover"), (j(("1", "a", "hallucination")), "another outcome")):
        with pytest.raises(ValueError, match=what):
            readers.cross_checked(results, golds, bad, ("a",), s)


def test_connectors(spark):
    calls = []

    def post(_):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return {"results": {"bindings": [{"x": {"value": "1"}}]}}

    assert K.graph_bindings(post, "q", 3, sleep=lambda _: None) == [{"x": "1"}]
    pages = {"title/a": {"title": "A"}, "text/A": {"text": "t"}, "title/b": {"title": None}, "title/c": {"error": "x"}, "title/d": {"title": "D"}}
    assert [K.article(pages.get, k)[0] for k in "abcde"] == ["ok", "absent", "unknown", "unknown", "unknown"]
    keys = spark.createDataFrame([("c",)], "key string")
    empty = spark.createDataFrame([], "key string, state string, entry struct<title:string,chunks:array<string>>")
    with pytest.raises(K.IncompleteFetch):
        K.read_through_chunks(keys, empty, pages.get, strict=True)
    now, slept = [0.0], []
    paced = K.Paced(lambda p: (p, {"prompt_tokens": 3}), per_minute=30, clock=lambda: now[0], sleep=slept.append)
    assert [paced("x"), paced("y")] == ["x", "y"] and slept == [2.0] and paced.counts == {"attempts": 2, "responses": 2, "prompt_tokens": 6}
    with pytest.raises(ZeroDivisionError):
        K.Paced(lambda p: 1 / 0)("x")


def test_role_slots(spark):
    q = spark.createDataFrame([("c", "q?")], "context string, question string")
    r = P.role_slots(q, "expert").first()
    assert r.system == "You are an expert of the question's field." and r.user.endswith("c\n\nq?")
    assert P.role_slots(q, "no_abstain", "user").first().user == f"{P.WITH_CONTEXT}\n\nc\n\nq?"
    with pytest.raises(ValueError):
        P.role_slots(q, "nobody")


def test_requests(spark):
    from veritrove.plans import requests as W

    lines = spark.createDataFrame([("Q1", 0, "[Paris] capital of: France")], "qid string, line_pos int, line string")
    configs = ("base_llm_abstain", "rag", "graph_rag", "rerank")
    ask = lambda **body: W.answer_request(spark, body, lines, configs, presets={"p": {"question": "Where?", "config": "rag", "entities": [{"qid": "Q1"}]}})
    got = ask(preset="p")
    assert got["answer"] == "[Paris] capital of: France" and got["evidence"] == ["[Paris] capital of: France"] and got["badge"] == "answered" and got["error"] is None
    assert ask(question="Who?", config="graph_rag", entities=[{"qid": "Q1", "label": "France"}])["evidence"] == ["[Paris] capital of: France"]
    assert ask(question="Who?", config="base_llm_abstain")["badge"] == "abstained" and "error" in ask(question="", config="rag") and ask(question="x", config="rag", entities=[{"qid": "1"}])["error"]
    assert W._running.acquire(blocking=False)
    try:
        with pytest.raises(W.Busy):
            ask(preset="p")
    finally:
        W._running.release()


def test_settings_and_seals(spark):
    from veritrove.operators import checks as C

    assert C.captured_settings({"k": 1}, lambda: ["out/a", "src/b"], ("out/",)) == {"k": 1, "clean": False, "changed": ["src/b"]}

    def unknown():
        raise OSError

    assert C.captured_settings({}, unknown)["clean"] is None
    with pytest.raises(RuntimeError):
        C.captured_settings({}, unknown, strict=True)
    q = spark.createDataFrame([("a",)], "id string")
    assert C.sealed_faults(q, q, True, None, "x", "y") and len(C.sealed_faults(q, q, True, None, "x", "y")) == 4 and C.sealed_faults(q, q.where("false"), False, True, "x", "x") == []


@pytest.mark.parametrize(("query_block", "line_block"), [(4096, 65_536), (7, 5)])
def test_nearest(spark, query_block, line_block):
    """Blocks of any size against every pair; ties, zeros, nulls and fewer lines than places."""
    import random

    r = random.Random(query_block)
    vectors = [[float(r.randrange(-2, 3)) for _ in range(4)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100, None), (None, [1.0, 0.0, 0.0, 0.0])]
    q, x = (spark.createDataFrame(rows, f"{n} bigint, embedding array<double>") for n in ("query_id", "line_id"))

    def score(a, b):
        norm = lambda v: sum(t * t for t in v) ** 0.5 + 1e-10
        return round(sum(s * t for s, t in zip(a, b, strict=True)) / norm(a) / norm(b), 12)

    for k, others in ((6, False), (6, True), (99, True)):
        want = {i: sorted((-score(v, w), j) for j, w in enumerate(vectors) if not others or i != j)[:k] for i, v in enumerate(vectors)}
        got = {}
        for row in R.nearest(q, x, k, others=others, query_block=query_block, line_block=line_block).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append((-row.score, row.line_id))
        assert {i: [(pytest.approx(s, abs=2e-12), j) for s, j in v] for i, v in want.items()} == got
    assert R.nearest(q.where("false"), x, 3).count() == 0 and R.nearest(q, x.where("false"), 3).count() == 0


def test_nearest_in_separate_partitions(spark):
    """Blocks meet where partitions aren't merged into one; equal vectors tie in any block."""
    import random

    r = random.Random(3)
    some = [[r.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, some[i % 12]) for i in range(96)]
    q, x = (spark.createDataFrame(rows, f"{n} bigint, embedding array<double>") for n in ("query_id", "line_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.nearest(q, x, 7, others=True, query_block=20, line_block=30).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((g.query_id, g["rank"], g.line_id) for g in got) == [(i, k + 1, j) for i in range(96) for k, j in enumerate(j for j in range(i % 12, 96, 12) if j != i)]


def test_exact_median_of_many(spark):
    """Groups of many different values, heavy tails, ties and a null group, against sorted lists."""
    import random
    import statistics

    r = random.Random(8)
    groups = {"wide": [r.paretovariate(0.3) * r.choice([-1, 1]) for _ in range(30_001)], "ties": [float(r.randrange(3)) for _ in range(20_000)], None: [r.random() for _ in range(7)], "one": [5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(6)
    assert {x.g: x["median"] for x in A.exact_median(df, ["g"], "v").collect()} == {g: pytest.approx(statistics.median(v), rel=1e-15) for g, v in groups.items()}
    assert {x.g: x.m for x in A.exact_median(df, ["g"], "v", "m", upper=True).collect()} == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}
    assert A.exact_median(df.where("g = 'one'"), [], "v").collect()[0][0] == 5.0


def test_search_names(spark):
    e = spark.createDataFrame([(1, "Paris"), (2, "Paris Texas"), (3, "New paris"), (4, None), (5, "Li"), (6, "Lima"), (7, "ab")], "qid int, label string")
    names = spark.createDataFrame([("paris",), ("PARIS",), ("li",), ("a",), ("zz",), ("",), (None,), ("parisx",)], "name string")
    got = {}
    for x in R.search_names(e, names, most=3).orderBy("name", "rank").collect():
        got.setdefault(x.name, []).append(x.qid)
    assert got == {"paris": [1, 3, 2], "PARIS": [1, 3, 2], "li": [5, 6], "a": [7, 6, 1]}
