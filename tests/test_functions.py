"""Scalar functions against hand-written expectations."""

import pytest
from pyspark.sql import functions as F

from veritrove.functions import entities as E
from veritrove.functions import numbers as N
from veritrove.functions import statements as S
from veritrove.functions import text as T

ONE = "id int"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(*texts):
    return F.array(*[F.lit(t) for t in texts]).cast("array<string>")


@pytest.mark.parametrize("text,expected", [("The Beatles!", "beatles"), ("  A  an THE the ", ""), ("U.S.A.", "usa"), ("Ünïcode word", "ünïcode word"), ("a the x an y", "x y"), (None, "")])
def test_normalize(spark, text, expected):
    assert value(spark, T.normalize(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("a,b,expected", [("Bono", "Bono", 1.0), ("the singer Bono", "Bono", 2 / 3), ("x", "y", 0.0), ("", "y", 0.0), ("x x y", "x y y", 2 / 3)])
def test_token_f1(spark, a, b, expected):
    got = value(spark, T.token_f1(F.lit(a), F.lit(b)))
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("text,refuses", [
    ("The context does not mention it.", True), ("This is not explicitly stated.", True), ("I don't know", True), ("no relevant information", True),
    ("Paris", False), ("", False), (None, False), ("It is known.", False), ("The context doesn't provide this", True)])
def test_is_abstention(spark, text, refuses):
    assert value(spark, T.is_abstention(F.lit(text).cast("string"))) is refuses


@pytest.mark.parametrize("answer,score,finish,outcome", [
    (None, 1.0, None, "other"), ("  ", 1.0, None, "other"), (T.SENTINEL, 1.0, None, "abstention"), (T.SENTINEL + " But it has dates.", 0.0, None, "abstention"),
    ("The context does not provide that: no", 1.0, None, "other"), ("Paris", 1.0, None, "correct"), ("Paris", 0.5, None, "correct"), ("Paris", 0.49, None, "hallucination"),
    ("Paris and more", 0.0, "length", "other"), ("Films by Neil Breen are listed, yet the year is not specified", 0.0, None, "other"), ("London", 0.0, "stop", "hallucination")])
def test_outcome(spark, answer, score, finish, outcome):
    got = value(spark, T.classify_outcome(F.lit(answer).cast("string"), F.lit(score), F.lit(finish).cast("string")))
    assert got == outcome


@pytest.mark.parametrize("text,expected", [("Yes, because", True), ("No.", False), ("That is correct", True), ("it is false", False), ("maybe", None), ("", None)])
def test_boolean(spark, text, expected):
    assert value(spark, T.boolean_of(F.lit(text))) is expected


@pytest.mark.parametrize("pred,gold,expected", [
    ("March 13, 2007", "2007-03-13", 1.0), ("13th March 2007", "2007-03-13", 1.0), ("2007-03-13", "2007-03-13", 1.0), ("in 2007", "2007-03-13", 1.0),
    ("14 March 2007", "2007-03-13", 0.0), ("2008", "2007", 0.0), ("born 1970", "1970", 1.0), ("13-Mar-07", "13-Mar-07", 1.0), ("sept. 3 1999", "1999-09-03", 1.0)])
def test_date_match(spark, pred, gold, expected):
    assert value(spark, T.date_match(F.lit(pred), F.lit(gold))) == expected


def test_entity_match_and_rivals(spark):
    rivals = T.rivals(lit("Southern Vampire Mysteries"), lit("The Wheel of Time", "The Southern Vampire Mysteries"))
    assert value(spark, rivals) == ["wheel of time"]
    first = F.lit("The Wheel of Time has more books than The Southern Vampire Mysteries")
    assert value(spark, T.entity_match(first, F.lit("The Southern Vampire Mysteries"), rivals)) == 0.0
    assert value(spark, T.entity_match(first, F.lit("The Southern Vampire Mysteries"))) == 1.0
    assert value(spark, T.rivals(lit("Vienna"), lit("Metropolis"))) == []
    assert value(spark, T.span_index(T.tokens(F.lit("x y z")), T.tokens(F.lit("y z")))) == 1
    assert value(spark, T.span_index(T.tokens(F.lit("x y z")), T.tokens(F.lit("z y")))) == -1


@pytest.mark.parametrize("text,expected", [
    ("1.5 million", [1500000.0]), ("2 million 300 thousand", [2300000.0]), ("2 million and 3 million", [2e6, 3e6]), ("Three 6 Mafia", [3.0, 6.0]),
    ("twenty three", [23.0]), ("twenty-three", [23.0]), ("260 million to 325 million", [2.6e8, 3.25e8]), ("2 million, 3 thousand", [2e6, 3e3]),
    ("one hundred and five", [105.0]), ("nineteen eighty", [19.0, 80.0]), ("20 3", [20.0, 3.0]), ("two hundred thousand", [200000.0]),
    ("the population is 2 million and the area is 300 thousand", [2e6, 3e5]), ("$1,234.5", [1234.5]), ("a million", [1e6]), ("none", []), ("", []), (None, [])])
def test_numbers(spark, text, expected):
    assert N.parse_numbers(text) == expected
    assert value(spark, N.numbers(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("pred,members,expected", [
    ("Matt Damon, Ben Affleck", ["Matt Damon", "Ben Affleck"], (1.0, 1.0)), ("Damon", ["Matt Damon", "Ben Affleck"], (1.0, 0.5)),
    ("Iron Man, Iron Man", ["Iron Man", "Iron Man 2"], (0.5, 0.5)), ("Bosnia and Herzegovina and Serbia", ["Bosnia and Herzegovina", "Serbia"], (1.0, 1.0)),
    ("", ["a1", "b1"], (0.0, 0.0)), ("- x1\n- y1", ["x1", "y1"], (1.0, 1.0))])
def test_set_match(spark, pred, members, expected):
    r = N.set_scores(pred, members)
    assert (r["precision"], r["recall"]) == expected
    assert N.set_scores(pred, [])["f1"] == 0.0 and N.set_scores(None, None)["f1"] == 0.0


@pytest.mark.parametrize("value_,precision,expected", [
    ("+1994-01-01T00:00:00Z", 9, "1994"), ("1994-05-01T00:00:00Z", 10, "1994-05"), ("1994-05-02T00:00:00Z", 11, "1994-05-02"), ("1990-01-01T00:00:00Z", 8, "1990s"),
    ("-0044-01-01T00:00:00Z", 9, "-0044"), ("1800-01-01T00:00:00Z", 7, "circa 1800"), ("+1994-01-01T00:00:00Z", None, "1994-01-01"), ("Paris", 9, "Paris")])
def test_tidy_time(spark, value_, precision, expected):
    assert value(spark, S.tidy_time(F.lit(value_), F.lit(precision).cast("int"))) == expected


@pytest.mark.parametrize("label,kind,mode,noise", [
    ("ISNI", "ExternalId", "property_type", True), ("ISNI", "ExternalId", "string", False), ("director", "WikibaseItem", "property_type", False),
    ("Commons category", "String", "property_type", True), ("Commons category", "String", "label_heuristic", False), ("topic has template", None, "datatype", True),
    ("NCI Thesaurus ID", "String", "property_type", True), ("NCI Thesaurus ID", "WikibaseItem", "property_type", False), ("facet of", None, "property_type", True)])
def test_noise(spark, label, kind, mode, noise):
    assert value(spark, S.is_noise(F.lit(label), F.lit(kind).cast("string"), mode)) is noise
    with pytest.raises(ValueError):
        S.is_noise(F.lit(label), None, "nonsense")


def test_snak_and_render(spark):
    s = lambda *a: value(spark, S.snak(*[F.lit(x).cast("string") for x in a]))
    assert s("http://x/entity/Q5", "human", "WikibaseItem").id == "Q5"
    assert s("http://x/entity/Q5", "Q5", "WikibaseItem").label is None
    assert s("http://x/entity/Q7", "Quebec", "WikibaseItem").label == "Quebec"
    assert s("http://x/.well-known/genid/1", None, "Time").snaktype == "somevalue"
    v = F.struct(F.lit("value").alias("snaktype"), F.lit("Time").alias("datatype"), F.lit(None).cast("string").alias("id"), F.lit("1994-01-01T00:00:00Z").alias("label"),
                 F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("unit"), F.lit(9).alias("precision"))
    q = F.array(F.struct(F.lit("P1").alias("property_id"), F.lit("for").alias("property_label"), v.alias("value")))
    assert value(spark, S.render_statement(F.lit("Tom Hanks"), F.lit("award"), v, q)) == "[Tom Hanks] award: 1994 (for: 1994)"
    assert value(spark, S.format_facts(F.lit("X"), lit())) == "No relevant facts found for X."


MENTIONS = "array<struct<name:string,entityType:string,label:string,mention:string,span:array<int>>>"


def test_packages(spark):
    rows = [("Q30", "entity", "United States", "Union", [42, 47]), ("Q30", "entity", "United States", "U.S.", [9, 13]), ("-1", "ordinal", None, "last", [0, 4]),
            ("XXXX-07-04", "date", None, "July 4", None), (None, "entity", None, "loose one", [60, 65]), ("4", "cardinal", None, "four", [20, 24])]
    df = spark.createDataFrame([(rows,)], f"m {MENTIONS}")
    p = df.select(E.packages(F.col("m")).alias("p")).first().p
    assert [x.kind for x in p] == ["ordinal", "entity", "cardinal", "entity", "date"]
    assert p[1].surface == "U.S." and p[1].mentions == ["U.S.", "Union"] and p[0].label == "last" and p[0].mentions == []
    assert p[4].label == "July 4 (any year)"
    block = df.select(E.prompt_block(F.col("m")).alias("b"), E.prompt_block(F.col("m"), "entity").alias("e")).first()
    assert block.b.startswith("Question entities:\n- (ordinal): last\n- Q30 (entity): United States — mentioned as") and "loose" not in block.b
    assert block.e.count("\n") == 1
    with pytest.raises(Exception, match="unknown entity type"):
        spark.createDataFrame([([("Q1", "planet", None, "x", None)],)], f"m {MENTIONS}").select(E.packages(F.col("m"))).collect()


@pytest.mark.parametrize("value_,shape", [("1900:1999", "range"), ("XXXX-01-02", "recurring"), ("44 BC", "bc"), ("1990-01-02", "iso"), ("1990-01", "month"), ("1990", "year"), ("90", "short"), ("soon", "other")])
def test_date_shape(spark, value_, shape):
    assert value(spark, E.date_shape(F.lit(value_))) == shape


def test_gold_answers(spark):
    g = lambda text: value(spark, E.gold_answer(F.lit(text)))
    two = g('{"answerType":"entity","mention":"them","answer":[{"name":"Q1","label":{"en":"A B"}},{"name":"Q2","label":{"en":"C"}}],"supportingNum":""}')
    assert two.members == ["A B", "C"] and two.qids == ["Q1", "Q2"] and two.forms == ["A B", "C", "them"] and two.supporting_number is None
    assert g('{"answerType":"boolean","mention":"Yes","answer":[true]}').forms == ["Yes"]
    assert g('{"answerType":"numerical","mention":"$2 million","answer":[2000000]}').forms == ["2000000", "$2 million"]
    assert g('{"answerType":"string","mention":"","answer":"After"}').forms == ["After"]
    with pytest.raises(Exception, match="unknown answer type"):
        g('{"answerType":"odd","answer":[1]}')


def test_split_words_context(spark):
    assert value(spark, T.split_set(F.lit("a1, b1 and c1; 2. d1\n- e1"))) == ["a1", "b1", "c1", "d1", "e1"]
    assert value(spark, T.word_count(F.lit(None).cast("string"))) is None and value(spark, T.word_count(F.lit(""))) == 0
    assert value(spark, T.gold_in_context(F.lit("He was born in Paris, France"), lit("Paris"), F.lit("entity"))) is True
    assert value(spark, T.gold_in_context(F.lit("in 1990"), lit("1990-02-03"), F.lit("date"))) is True
    assert value(spark, T.gold_in_context(F.lit("x"), lit("Yes"), F.lit("boolean"))) is None
    assert value(spark, T.strip_reasoning(F.lit("<think>a</think> b <think>c"))) == "b"
    assert value(spark, N.as_number(F.lit("1 234,5"))) == 12345.0 and value(spark, N.as_number(F.lit("1.234.567"))) == 1234567.0 and value(spark, N.as_number(F.lit("x"))) is None
