"""Digests of joined groups against Python's, with groups that span tasks."""

import hashlib
import random

from veritrove.operators import digest as D


def joined(rows, sep, order):
    out = {}
    for k, m in rows:
        if m is not None:
            out.setdefault(k, []).append(m)
    return {(*k, len(v), hashlib.sha256(sep.join(str(x) for x in sorted(v, key=order)).encode()).hexdigest()) for k, v in out.items()}


def test_joined_digests(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_BYTES", 50)
    r = random.Random(3)
    rows = [((r.choice([None, 1, 2, 3]), r.choice(["a", None, ""])), r.randrange(10**6)) for _ in range(800)]
    rows += [((7, "hot"), i) for i in range(2500)] + [((8, "one"), 5), ((9, "none"), None)] + [((i, "small"), i) for i in range(100, 400)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*k, m) for k, m in rows], "g bigint, h string, v bigint").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", parts == "1")
        got = D.joined_digests(df, ["g", "h"], "v").collect()
        assert len(got) == len(set(map(tuple, got))) and {tuple(x) for x in got} == joined(rows, ",", int)
        assert {tuple(x) for x in D.joined_digests(df.withColumn("s", df.v.cast("string")), ["g", "h"], "s", separator="\n").collect()} == joined(rows, "\n", str)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", True)
    assert D.joined_digests(df.where("false"), ["g"], "v").count() == 0
