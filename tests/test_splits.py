"""Array and line files split at every place, against json.loads."""

import json
import random

import pytest

from veritrove.sources import readers, splits


@pytest.fixture
def small_ranges(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def value(r, depth=0):
    kind = r.randrange(9 if depth < 3 else 5)
    if kind < 3:
        return "".join(r.choice(["a", '"', "\\", "}", "{", "]", "[", ",", "é", "\\\"", " ", "\n", "x" * 30]) for _ in range(r.randrange(12)))
    if kind < 5:
        return r.choice([None, True, 1, -2.5, 10**12])
    if kind < 7:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {f"k{i}" + r.choice(["", "}", '"']): value(r, depth + 1) for i in range(r.randrange(4))}


@pytest.mark.parametrize("seed", range(3))
def test_arrays(spark, tmp_path, small_ranges, seed):
    r, want = random.Random(seed), []
    for name in ("b", "a", "d", "c", "e", "f"):
        items = [value(r) for _ in range({"a": 1, "b": 60, "c": 0, "d": 25}.get(name, 0))]
        text = {"e": "", "f": " \n"}.get(name, json.dumps(items, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5))
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        want.append((name, items))
    want = [x for _, items in sorted(want) for x in items]
    df = splits.array_records(spark, str(tmp_path))
    got = sorted(df.collect())
    assert [json.loads(x.record) for x in got] == want and len({x.pos for x in got}) == len(want)
    assert splits.text_pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 20


def test_what_is_no_array(spark, tmp_path, small_ranges):
    for i, text in enumerate(('{"a": [1, 2], "b": [3]}', "[]", "[ ]", "7", '"x, [y]"')):
        (tmp_path / f"{i}.json").write_text(text)
    assert splits.array_records(spark, str(tmp_path)).count() == 0
    (tmp_path / "5.json").write_text("[1, [2, 3], \"a,b\"]")
    assert [x.record for x in splits.array_records(spark, str(tmp_path)).orderBy("pos").collect()] == ["1", "[2,3]", '"a,b"']


def test_lines_of_several_files(spark, tmp_path, small_ranges):
    """A short first file and a long second one: positions follow the names, not the sizes."""
    r = random.Random(1)
    texts = {"a": ["first"], "b": [f"line {i} " + "x" * r.randrange(40) for i in range(80)], "c": ["", " ", "last"]}
    for name, lines in texts.items():
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + ("\n" if name == "b" else ""))
    got = splits.line_records(spark, str(tmp_path)).orderBy("pos").collect()
    assert [x.record for x in got] == [x for name in "abc" for x in texts[name] if x.strip()] and len({x.pos for x in got}) == len(got)


def test_questions_over_splits(spark, tmp_path, small_ranges):
    rows = [{"id": f"q{i}", "question": "} [" * (i % 5), "questionEntity": [], "answer": {"answerType": "string", "answer": [str(i)]}} for i in range(50)]
    (tmp_path / "q.json").write_text(json.dumps(rows))
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for path, lines in (("q.json", False), ("q.jsonl", True)):
        got = readers.read_questions(spark, str(tmp_path / path), lines=lines).orderBy("pos").collect()
        assert [(x.id, x.question) for x in got] == [(x["id"], x["question"]) for x in rows]


@pytest.mark.parametrize("seed", range(3))
def test_members_of_objects(spark, tmp_path, small_ranges, seed):
    """The array that a member is, split at every place; members before and after it, other kinds of it, and bare lists."""
    r, want = random.Random(seed), []
    for name in ("b", "a", "c", "d", "e", "g", "h"):
        items = [value(r) for _ in range({"a": 1, "c": 0}.get(name, 40))]
        file = {f"x{i}": value(r) for i in range(3)} | {"judge_sha256": {"a": "é}\"", "b": 7, "c": None}.get(name, "abc"), "cases": items} | {f"y{i}": value(r) for i in range(3)}
        if name == "d":
            file, items = {"cases": {"a": [1, 2], "b": 3}}, []
        if name == "e":
            file, items = {"cases": None, "other": [1, 2]}, []
        if name == "g":
            file = items
        if name == "h":
            file = {"cases": items}
        text = json.dumps(file, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        (tmp_path / f"{name}.json").write_text(text + r.choice(["", "\n"]), encoding="utf-8")
        h = file.get("judge_sha256") if isinstance(file, dict) else None
        want += [(h if h is None else str(h), json.dumps(x, sort_keys=True)) for x in items]
    got = readers.sidecar(spark, str(tmp_path))
    assert sorted([(g.source_hash, json.dumps(json.loads(g.case), sort_keys=True)) for g in got.collect()], key=repr) == sorted(want, key=repr)
    assert got.rdd.getNumPartitions() > 20  # whole files gave one row each
