"""Question mentions and gold answers as Column expressions over arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import as_number
from .text import strip

# Mention types, answer types, headings.
LITERALS = ("ordinal", "date", "cardinal", "quantity", "money", "percent", "time")
MENTION_TYPES = ("entity", *LITERALS)
ANSWER_TYPES = ("entity", "numerical", "boolean", "string", "date")
HEADER = "Question entities:"
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
FAR = 1 << 30


def checked_types(mentions: Column) -> Column:
    """The mentions; a type outside the closed list fails at run time."""
    bad = F.filter(mentions, lambda m: ~F.coalesce(m["entityType"].isin(*MENTION_TYPES), F.lit(False)))
    return F.when(F.size(bad) > 0, F.raise_error(F.lit("unknown entity type"))).otherwise(mentions)


def span_key(m: Column) -> Column:
    ok = F.size(m["span"]) == 2
    return F.struct(F.when(ok, F.get(m["span"], F.lit(0))).otherwise(FAR).alias("a"), F.when(ok, F.get(m["span"], F.lit(1))).otherwise(FAR).alias("b"))


def _least_span(ms: Column) -> Column:
    return F.array_min(F.transform(ms, span_key))


def _unique(texts: Column) -> Column:
    return F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != "")))


def same_surface(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


def entity_packages(mentions: Column) -> Column:
    """One struct for each linked entity - merged by key, mentions in reading order - then unlinked ones.

    Fields: kind, name, label, mentions (other than the label), surface (the
    earliest mention), span, linked.
    """
    own = F.filter(checked_types(F.coalesce(mentions, F.array().cast(ARRAY))), lambda m: m["entityType"] == "entity")
    linked = F.filter(own, lambda m: F.coalesce(m["name"], F.lit("")) != "")
    keys = F.array_distinct(F.transform(linked, lambda m: m["name"]))

    def merge(key: Column) -> Column:
        mine = F.filter(linked, lambda m: m["name"] == key)
        said = F.filter(mine, lambda m: strip(m["mention"]) != "")
        ordered = F.array_sort(F.transform(said, lambda m, i: F.struct(span_key(m).alias("s"), i.alias("i"), strip(m["mention"]).alias("m"))))
        texts = _unique(F.transform(ordered, lambda o: o["m"]))
        head = F.get(mine, F.lit(0))
        label = F.coalesce(F.nullif(head["label"], F.lit("")), strip(head["mention"]))
        shown = F.filter(texts, lambda t: ~same_surface(label, t))
        return F.struct(
            F.lit("entity").alias("kind"), key.alias("name"), label.alias("label"), shown.alias("mentions"),
            F.coalesce(F.get(texts, F.lit(0)), F.get(shown, F.lit(0)), label).alias("surface"), _least_span(mine).alias("span"), F.lit(True).alias("linked"))

    loose = F.filter(own, lambda m: (F.coalesce(m["name"], F.lit("")) == "") & (strip(m["mention"]) != ""))
    texts = _unique(F.transform(loose, lambda m: strip(m["mention"])))

    def single(t: Column) -> Column:
        mine = F.filter(loose, lambda m: strip(m["mention"]) == t)
        return F.struct(
            F.lit("entity").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("label"), F.array(t).alias("mentions"),
            t.alias("surface"), span_key(F.get(mine, F.lit(0))).alias("span"), F.lit(False).alias("linked"))

    return F.concat(F.transform(keys, merge), F.transform(texts, single))


ARRAY = "array<struct<name:string,entityType:string,label:string,mention:string,span:array<int>>>"


def date_shape(value: Column) -> Column:
    s = strip(value)
    return (
        F.when(F.contains(s, F.lit(":")), "range").when(F.contains(s, F.lit("XXXX")), "recurring").when(F.upper(s).endswith("BC"), "bc")
        .when(s.rlike("^(\\d{4}|XXXX)-\\d{2}-\\d{2}$"), "iso").when(s.rlike("^(\\d{4}|XXXX)-\\d{2}$"), "month")
        .when(s.rlike("^\\d{4}$"), "year").when(s.rlike("^\\d{1,3}$"), "short").otherwise("other"))


def date_value(value: Column) -> Column:
    """The date as written; a year of XXXX reads as any year."""
    s = strip(value)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.greatest(F.lit(1), F.least(F.lit(12), F.coalesce(F.regexp_extract(s, "^XXXX-(\\d{2})", 1).try_cast("int"), F.lit(1)))))
    day = F.regexp_extract(s, "^XXXX-\\d{2}-(\\d{2})$", 1).try_cast("int").cast("string")
    return F.when(s.rlike("^XXXX-\\d{2}-\\d{2}$"), F.concat(month, F.lit(" "), day, F.lit(" (any year)"))).when(s.rlike("^XXXX-\\d{2}$"), F.concat(month, F.lit(" (any year)"))).otherwise(s)


def shown_value(kind: Column, name: Column) -> Column:
    """What a literal's line prints: its value, an ordinal of -1 as 'last', a date in words where its year is open."""
    return F.when((kind == "ordinal") & (as_number(name) == -1), "last").when(kind == "date", date_value(name)).otherwise(name)


def literal_packages(mentions: Column, kinds=LITERALS) -> Column:
    """One struct for each literal mention, none merged; a mention that says what the value says is dropped."""
    own = F.filter(checked_types(F.coalesce(mentions, F.array().cast(ARRAY))), lambda m: m["entityType"].isin(*kinds))

    def one(m: Column) -> Column:
        shown, said = shown_value(m["entityType"], m["name"]), strip(m["mention"])
        same = same_surface(shown, said) | F.coalesce(as_number(shown) == as_number(said), F.lit(False))
        kept = F.when(same | (said == ""), F.array().cast("array<string>")).otherwise(F.array(said))
        return F.struct(m["entityType"].alias("kind"), m["name"].alias("name"), shown.alias("label"), kept.alias("mentions"), said.alias("surface"), span_key(m).alias("span"), F.lit(True).alias("linked"))

    return F.transform(own, one)


def packages(mentions: Column) -> Column:
    """All packages in reading order: by span, those without one last, then by type."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(MENTION_TYPES) for x in (k, i)])
    both = F.concat(entity_packages(mentions), literal_packages(mentions))
    keyed = F.transform(both, lambda p, i: F.struct(p["span"].alias("s"), F.element_at(order, p["kind"]).alias("t"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda k: k["p"])


def render_package(p: Column) -> Column:
    said = F.array_join(F.transform(p["mentions"], lambda m: F.concat(F.lit('"'), m, F.lit('"'))), ", ")
    tail = F.when(F.size(p["mentions"]) > 0, F.concat(F.lit(" — mentioned as "), said)).otherwise("")
    line = F.when(p["kind"] == "entity", F.concat(F.lit("- "), p["name"], F.lit(" (entity): "), p["label"])).otherwise(F.concat(F.lit("- ("), p["kind"], F.lit("): "), p["label"]))
    return F.when(~p["linked"], F.concat(F.lit('- (entity, no Wikidata id): "'), p["surface"], F.lit('"'))).otherwise(F.concat(line, tail))


def prompt_block(mentions: Column, mode: str = "all") -> Column:
    """The heading and a line for each package that is linked; mode 'entity' leaves literals out. Empty for none."""
    if mode not in ("all", "entity"):
        raise ValueError(f"unknown block mode {mode!r}")
    shown = F.filter(packages(mentions), lambda p: p["linked"] & (F.lit(mode == "all") | (p["kind"] == "entity")))
    return F.when(F.size(shown) == 0, "").otherwise(F.concat(F.lit(HEADER + "\n"), F.array_join(F.transform(shown, render_package), "\n")))


def linked(mentions: Column, field: str) -> Column:
    """One field (name, label or surface) of the linked entities in reading order."""
    return F.transform(F.filter(packages(mentions), lambda p: (p["kind"] == "entity") & p["linked"]), lambda p: p[field])


def ordered_distinct(texts: Column) -> Column:
    """The first spelling of each text, compared without case and runs of white space."""
    keyed = F.filter(F.transform(texts, lambda t: F.struct(F.lower(F.regexp_replace(strip(t), "\\s+", " ")).alias("k"), strip(t).alias("t"))), lambda x: x["k"] != "")
    keys = F.transform(keyed, lambda x: x["k"])
    return F.transform(F.filter(F.transform(keyed, lambda x, i: F.struct(x["t"].alias("t"), (F.array_position(keys, x["k"]) == i + 1).alias("first"))), lambda x: x["first"]), lambda x: x["t"])


def gold_answer(answer: Column) -> Column:
    """A gold answer from its JSON text: struct(answer_type, mention, forms, members, qids, supporting_number).

    The payload is a list of entities, of one scalar, or a bare scalar. An
    unknown answer type fails at run time.
    """
    j = F.try_parse_json(answer)
    get = lambda path, kind="string": F.try_variant_get(j, path, kind)
    kind = get("$.answerType")
    known = F.when(F.coalesce(kind.isin(*ANSWER_TYPES), F.lit(False)), kind).otherwise(F.raise_error(F.concat(F.lit("unknown answer type "), F.coalesce(kind, F.lit("null")))))
    entity = F.from_json(F.get_json_object(answer, "$.answer"), "array<struct<name:string,label:struct<en:string>>>")
    entity = F.when(kind == "entity", F.coalesce(entity, F.array().cast("array<struct<name:string,label:struct<en:string>>>")))
    labels = F.filter(F.transform(entity, lambda e: e["label"]["en"]), lambda x: x.isNotNull())
    value = F.coalesce(get("$.answer[0]"), F.when(~F.coalesce(F.get_json_object(answer, "$.answer").startswith("["), F.lit(False)), get("$.answer")))
    shown = F.when((kind == "boolean") & (value == "true"), "Yes").when((kind == "boolean") & (value == "false"), "No").otherwise(value)
    mention = strip(get("$.mention"))
    base = F.when(kind == "entity", labels).otherwise(F.filter(F.array(shown), lambda x: x.isNotNull()))
    distinct = ordered_distinct(F.coalesce(labels, F.array().cast("array<string>")))
    return F.struct(
        known.alias("answer_type"), mention.alias("mention"), ordered_distinct(F.concat(base, F.array(mention))).alias("forms"),
        F.when(F.size(distinct) >= 2, distinct).otherwise(F.array().cast("array<string>")).alias("members"),
        F.filter(F.transform(entity, lambda e: e["name"]), lambda x: x.isNotNull()).alias("qids"),
        F.nullif(strip(get("$.supportingNum")), F.lit("")).alias("supporting_number"))


def without_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^[cqa]_", "")


PACKAGE = "struct<kind:string,name:string,label:string,mentions:array<string>,surface:string,span:struct<a:int,b:int>,linked:boolean>"


def packages_to_json(p: Column) -> Column:
    """Packages as JSON text."""
    return F.to_json(p)


def packages_from_json(j: Column) -> Column:
    return F.from_json(j, f"array<{PACKAGE}>")


def evidence_of(config: Column, context: Column) -> Column:
    """A context's parts as a reader sees them: statement lines of graph configs, blank-line separated texts of others; none without a context."""
    lines = F.filter(F.transform(F.split(context, "\n"), lambda x: F.regexp_replace(strip(x), "^- ", "")), lambda x: (x != "") & x.startswith("["))
    texts = F.filter(F.transform(F.split(context, "\n\n"), strip), lambda x: x != "")
    return F.when(F.coalesce(strip(context), F.lit("")) == "", F.array().cast("array<string>")).when(config.isin("graph_rag", "rerank"), lines).otherwise(texts)


def badge(outcome: Column, answer: Column) -> Column:
    """What a reader is told of an answer: abstained, refusal-shaped, empty or answered."""
    from .text import is_abstention

    return F.when(outcome == "abstention", "abstained").when(strip(answer) == "", "empty").when((outcome == "other") & is_abstention(answer), "refusal-shaped").otherwise("answered")
