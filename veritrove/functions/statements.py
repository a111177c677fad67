"""Graph statements: typed values, noise filters, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import starts_with_any

# Property types and labels that carry no facts.
NOISE_TYPES = (
    "ExternalId", "CommonsMedia", "Url", "GeoShape", "TabularData", "Math", "MusicalNotation",
    "WikibaseForm", "WikibaseSense", "WikibaseLexeme", "WikibaseEntitySchema",
)
NOISE_LABELS = ("described by source", "different from", "said to be the same as", "permanent duplicated item", "facet of")
UNKNOWN, NONE = "(unknown value)", "(no value)"
MODES = {"property_type": "property_type", "label_heuristic": "label_heuristic", "datatype": "property_type", "string": "label_heuristic"}
RANKS = ("preferred", "normal")


def local_name(iri: Column) -> Column:
    """What follows the last slash or hash."""
    return F.regexp_extract(iri, "([^/#]*)$", 1)


def snak(iri: Column, label: Column, datatype: Column, unit: Column | None = None, precision: Column | None = None) -> Column:
    """A typed value from a binding's cells."""
    unit = F.lit(None).cast("string") if unit is None else unit
    precision = F.lit(None).cast("int") if precision is None else precision
    unknown = F.coalesce(F.contains(iri, F.lit("/.well-known/genid/")), F.lit(False))
    entity = F.coalesce(F.contains(iri, F.lit("/entity/")), F.lit(False)) & ~unknown
    return F.struct(
        F.when(unknown, "somevalue").otherwise("value").alias("snaktype"),
        F.coalesce(datatype, F.lit("")).alias("datatype"),
        F.when(entity, local_name(iri)).alias("id"),
        F.when(~unknown & ~F.coalesce(label.rlike("^Q\\d+$"), F.lit(False)), label).alias("label"),
        F.when(~entity & (iri != ""), iri).alias("raw"),
        F.when(~unknown & ~unit.isin("", "1", "Q199"), unit).alias("unit"),
        precision.alias("precision"),
    )


def rank_kept(rank: Column, policy=RANKS) -> Column:
    return rank.isin(*policy)


def is_noise(label: Column, datatype: Column | None = None, mode: str = "property_type") -> Column:
    """Whether a property is bookkeeping rather than a fact, by its type or by its label alone."""
    if mode not in MODES:
        raise ValueError(f"unknown noise filter mode {mode!r}")
    low = F.lower(label)
    names_id = low.endswith(" id") | F.contains(low, F.lit("identifier"))
    wiki = F.contains(low, F.lit("wikiproject")) | F.contains(low, F.lit("wikimedia"))
    if MODES[mode] == "label_heuristic":
        return wiki | starts_with_any(low, ("category", "template", "topic's main")) | low.isin(*NOISE_LABELS) | names_id
    datatype = F.lit(None).cast("string") if datatype is None else datatype
    return (
        F.coalesce(datatype.isin(*NOISE_TYPES), F.lit(False))
        | wiki | F.contains(low, F.lit("commons"))
        | starts_with_any(low, ("category", "template", "topic's main", "topic has"))
        | low.isin(*NOISE_LABELS)
        | ((datatype.isNull() | F.coalesce(datatype == "String", F.lit(False))) & names_id)
    )


def tidy_time(value: Column, precision: Column) -> Column:
    """A time as far as its precision goes: 11 day, 10 month, 9 year, 8 decade, below that about a year."""
    midnight = value.endswith("T00:00:00Z")
    t = F.when(midnight, F.regexp_replace(F.regexp_replace(value, "T00:00:00Z$", ""), "^\\+", "")).otherwise(value)
    sign = F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.when(t.startswith("-"), F.substring(t, 2, 1 << 30)).otherwise(t)
    part = F.split(body, "-")
    year = F.concat(sign, F.get(part, F.lit(0)))
    return (
        F.when(precision.isNull() | ~body.rlike("^\\p{Nd}") | (precision >= 11), t)
        .when(precision == 10, F.concat(sign, F.array_join(F.slice(part, 1, 2), "-")))
        .when(precision == 9, year).when(precision == 8, F.concat(year, F.lit("s")))
        .otherwise(F.concat(F.lit("circa "), year))
    )


def render_snak(v: Column) -> Column:
    shown = F.coalesce(F.nullif(v["label"], F.lit("")), F.nullif(v["raw"], F.lit("")), F.lit(UNKNOWN))
    full = F.concat_ws(" ", tidy_time(shown, v["precision"]), F.nullif(v["unit"], F.lit("")))
    return F.when(v["snaktype"] == "somevalue", UNKNOWN).when(v["snaktype"] == "novalue", NONE).otherwise(full)


def sorted_qualifiers(qualifiers: Column) -> Column:
    """By property, then by what the value shows: label, raw, id or kind, the first there is."""
    keyed = F.transform(qualifiers, lambda q: F.struct(
        q["property_id"].alias("p"),
        F.coalesce(*[F.nullif(q["value"][c], F.lit("")) for c in ("label", "raw", "id")], q["value"]["snaktype"]).alias("v"), q.alias("q")))
    return F.transform(F.array_sort(keyed), lambda k: k["q"])


def render_statement(subject: Column, prop: Column, value: Column, qualifiers: Column) -> Column:
    inner = F.array_join(F.transform(qualifiers, lambda q: F.concat(q["property_label"], F.lit(": "), render_snak(q["value"]))), "; ")
    line = F.concat(F.lit("["), subject, F.lit("] "), prop, F.lit(": "), render_snak(value))
    return F.when(F.coalesce(F.size(qualifiers), F.lit(0)) > 0, F.concat(line, F.lit(" ("), inner, F.lit(")"))).otherwise(line)


def format_facts(label: Column, facts: Column) -> Column:
    """A heading and a bullet for each fact; a sentence where there is none."""
    bullets = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")
    return F.when(F.size(facts) > 0, F.concat(F.lit("Wikidata facts about "), label, F.lit(":\n"), bullets)).otherwise(
        F.concat(F.lit("No relevant facts found for "), label, F.lit(".")))
