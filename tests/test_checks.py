"""Strict joins, set comparisons, validation, and the bindings source."""

import json

import pytest
from pyspark.sql import functions as F

from veritrove.operators import checks as K
from veritrove.sources import bindings, sinks


def test_joins(spark):
    a = spark.createDataFrame([("x", ""), ("y", "k")], "id string, kind string")
    b = spark.createDataFrame([("x", "from b"), ("y", "no")], "id string, kind string")
    assert K.strict_join(a, b.select("id"), "id").count() == 2
    with pytest.raises(Exception, match="no partner for y"):
        K.strict_join(a, b.where("id = 'x'").select("id"), "id").collect()
    assert {r.id: r.kind for r in K.filled(a, b, "id", ("kind",)).collect()} == {"x": "from b", "y": "k"}
    assert K.different_ids(a, b).isEmpty() and K.different_ids(a, b.unionByName(b)).count() == 2 and K.different_ids(a, b.where("id = 'x'")).count() == 1
    assert K.sealed_overlap(a, b.where("id = 'x'")) == 1


def test_consistency(spark):
    s = spark.createDataFrame([("q1", "rag", "correct"), ("q2", "rag", "other")], "question_id string, config string, outcome string")
    j = spark.createDataFrame([("q1", "rag", "correct", None), ("q2", "rag", "correct", 0.5), ("q3", "rag", "other", None)], "id string, config string, outcome string, score double")
    r = K.consistent(j, s).first()
    assert (r.excluded, r.unscored, r.mismatches) == (1, 1, 1)


def test_readiness_and_sets(spark):
    q = spark.createDataFrame([(1, ["A", "B"]), (2, ["A"]), (3, [])], "question_id int, qids array<string>")
    states = spark.createDataFrame([("A", "ok"), ("B", "stale")], "key string, state string")
    assert [r.question_id for r in K.ready(q, states).collect()] == [2]
    assert spark.range(1).select(K.subset(F.array(F.lit(1.0)), F.array(F.lit(2.0), F.lit(1.0))).alias("v")).first().v is True


def test_requests():
    good = {"question": "Who?", "config": "rag", "entities": [{"qid": "Q5"}]}
    assert K.request_fault(good, ("rag",)) is None
    for bad in ([], {}, {**good, "question": "x" * 501}, {**good, "config": "odd"}, {**good, "entities": [{"qid": "Q0"}]}, {**good, "entities": [{"qid": "Q1"}] * 21}):
        assert K.request_fault(bad, ("rag",))
    assert K.deviations({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b is 2, pinned 3"]


def test_bindings(spark, tmp_path):
    (tmp_path / "Q1.json").write_text(json.dumps({"results": {"bindings": [{"st": {"value": "s1"}, "prop": {"value": "P1"}}, {"st": {"value": "s2"}}]}}))
    rows = bindings.stored_bindings(spark, str(tmp_path)).collect()
    assert sorted((r.key, r.cells["st"]) for r in rows) == [("Q1", "s1"), ("Q1", "s2")]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert bindings.with_retries(flaky, 3, sleep=lambda s: None) == "done"
    with pytest.raises(OSError):
        bindings.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=lambda s: None)


def test_bindings_that_are_none(spark, tmp_path):
    (tmp_path / "Q2.json").write_text('{"error": "busy"}')
    with pytest.raises(Exception, match="not a reply: Q2"):
        bindings.stored_bindings(spark, str(tmp_path)).collect()


def test_html_report(spark):
    page = sinks.html_report("A & B", {"first": spark.createDataFrame([("<x>", 1), (None, 2)], "name string, n int"), "second": spark.range(1)})
    assert page.count("<section") == 2 and page.count(" hidden>") == 1 and "<td>&lt;x&gt;</td>" in page and "<td>—</td>" in page and "<h1>A &amp; B</h1>" in page
    assert "http" not in page
    with pytest.raises(ValueError):
        sinks.html_report("t", {"x": spark.range(5)}, most=4)
