"""The keyed cache: upserts, removals, writers at once, compaction, lookups and read-through."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veritrove.sources import cache as C
from veritrove.sources import connectors as K


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, v bigint")


def content(spark, path, keys=None):
    return {r.id: r.v for r in C.entries(spark, path, keys).collect()}


def files_read(df):
    """Files that a plan's scans of the cache opened."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        return sum(s.metrics().apply("numFiles").value() for s in scans if s.nodeName().startswith("Scan parquet"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_upsert_keeps_others(spark, tmp_path):
    path = str(tmp_path / "c")
    C.upsert(table(spark, [(f"k{i}", i) for i in range(100)]), path, "id", 4)
    C.upsert(table(spark, [("k200", 200)]), path, "id")
    C.upsert(table(spark, [("k3", -3)]), path, "id")
    assert content(spark, path) == {f"k{i}": i for i in range(100)} | {"k200": 200, "k3": -3}
    with pytest.raises(ValueError):
        C.upsert(table(spark, [("a", 1)]), path, "id", 8)
    with pytest.raises(LookupError):
        C.entries(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="without a key"):
        C.upsert(table(spark, [(None, 1)]), path, "id")
    assert len(C.writes(spark, path)) == 3, "a write that failed isn't there"


def test_random_rounds(spark, tmp_path):
    """Upserts, removals and compactions in any order, against a dictionary."""
    r, path, want = random.Random(4), str(tmp_path / "c"), {}
    for step in range(12):
        some = {f"k{r.randrange(30)}": step for _ in range(8)}
        what = r.choice(["put", "put", "drop", "compact"]) if want else "put"
        if what == "put":
            C.upsert(table(spark, list(some.items())), path, "id", 3)
            want |= some
        elif what == "drop":
            C.remove(table(spark, list(some.items())), path, "id")
            want = {k: v for k, v in want.items() if k not in some}
        else:
            C.compact(spark, path)
        assert content(spark, path) == want


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """Writers that saw the same log, and a compaction that saw less than it replaces: no entry is lost, and merging again changes nothing."""
    path = str(tmp_path / "c")
    C.upsert(table(spark, [("a", 1), ("b", 1)]), path, "id", 2)
    C.upsert(table(spark, [("b", 2), ("c", 2)]), path, "id")
    seen = C.writes(spark, path)
    with monkeypatch.context() as m:
        m.setattr(C, "writes", lambda *_: seen)
        x = C.upsert(table(spark, [("d", 3), ("e", 3)]), path, "id")
        y = C.upsert(table(spark, [("e", 4), ("f", 4)]), path, "id")
        C.remove(table(spark, [("a", 0)]), path, "id")
        C.compact(spark, path)
        C.compact(spark, path)
    want = {"b": 2, "c": 2, "d": 3, "e": 3 if x > y else 4, "f": 4}
    assert content(spark, path) == want
    C.compact(spark, path)
    assert content(spark, path) == want and len(C.writes(spark, path)) == 1
    assert C.vacuum(spark, path) == 0 and C.vacuum(spark, path, -1) > 0
    assert content(spark, path) == want and len(list((tmp_path / "c" / "data").iterdir())) == 1


def test_unfinished_write(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    C.upsert(table(spark, [("a", 1)]), path, "id", 2)

    def fail(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(C, "put_text", fail)
        with pytest.raises(RuntimeError):
            C.upsert(table(spark, [("a", 2)]), path, "id")
    assert content(spark, path) == {"a": 1}


def test_order_columns_and_schema(spark, tmp_path):
    path = str(tmp_path / "c")
    C.upsert(table(spark, [("a", 1), ("a", 5), ("a", 3)]), path, "id", 2, order="v")
    C.upsert(spark.createDataFrame([("b", 7, {"x": [1]})], "id string, v bigint, more map<string,array<int>>"), path, "id")
    rows = {r.id: r for r in C.entries(spark, path).collect()}
    assert rows["a"].v == 5 and rows["a"].more is None and rows["b"].more == {"x": [1]}


def test_lookup_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "c")
    C.upsert(table(spark, [(f"k{i}", i) for i in range(3000)]), path, "id", 50)
    keys = [f"k{i}" for i in range(7, 3000, 300)]
    want = {k: int(k[1:]) for k in keys}
    assert content(spark, path, keys) == want and content(spark, path, [*keys, "none"]) == want
    by_table = C.entries(spark, path, spark.createDataFrame([(k,) for k in keys], "id string"))
    assert {r.id: r.v for r in by_table.collect()} == want
    assert files_read(C.entries(spark, path)) == 50 and files_read(C.entries(spark, path, keys)) <= 10 and files_read(by_table) <= 10
    assert "PushedFilters: [In(id" in C.entries(spark, path, keys)._jdf.queryExecution().toString()
    found = C.states(spark, path, spark.createDataFrame([("k7",), ("zz",)], "id string"), F.when(F.col("v") > 5, "ok"))
    assert {r.id: r.state for r in found.collect()} == {"k7": "ok", "zz": "missing"}


def test_read_through(spark, tmp_path):
    path = str(tmp_path / "c")
    keys = spark.createDataFrame([("a",), ("b",), ("b",), ("x",), (None,)], "id string")

    def fetch(wanted):
        return wanted.select("id", F.length("id").cast("bigint").alias("v")).where("id <> 'x'")

    assert {r.id for r in K.through_cache(keys, path, fetch, "id").collect()} == {"a", "b"}
    C.upsert(table(spark, [("b", 9)]), path, "id")
    assert {r.id: r.v for r in K.through_cache(keys.unionByName(spark.createDataFrame([("c",)], "id string")), path, fetch, "id").collect()} == {"a": 1, "b": 9, "c": 1}
    with pytest.raises(K.IncompleteFetch, match="x"):
        K.through_cache(keys, path, fetch, "id", strict=True)


def test_put_text(spark, tmp_path):
    C.put_text(spark, str(tmp_path / "f.json"), json.dumps([1]))
    C.put_text(spark, f"file://{tmp_path}/f.json", json.dumps([2]))
    assert json.loads((tmp_path / "f.json").read_text()) == [2] and not [p for p in tmp_path.iterdir() if "tmp" in p.name and not p.name.endswith(".crc")]
