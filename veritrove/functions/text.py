"""Text matching and answer classification as Column -> Column functions.

Everything here stays in Catalyst: no user functions. Patterns carry (?U)
where word and space classes have to cover all of Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What results depend on.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
SENTINEL = "The answer is not in the context."
YES = ("yes", "true", "correct", "right", "affirmative")
NO = ("no", "not", "false", "incorrect", "wrong", "negative")
THRESHOLD = 0.5
REFUSAL_HEAD, REFUSAL_LEAD = 90, 30
GAP = r"(?:\w+\s+){0,2}"
REFUSALS = (
    "not {g}(?:in|provided in|found in|contained in|present in) the context",
    "answer is not {g}(?:in|available|provided|present|given)",
    "(?:cannot|can't|can not|could not|couldn't) {g}(?:answer|determine|provide|find|tell|say|confirm|identify|be determined|be found)",
    "(?:unable|not able) to {g}(?:answer|determine|find|provide|tell|say|identify|confirm|verify)",
    "not possible to {g}(?:answer|determine|tell|say|know|identify)",
    "(?:no|not enough|not sufficient|insufficient) {g}(?:information|context|data|details|evidence|facts)",
    "(?:do not|does not|did not|don't|doesn't|didn't) {g}(?:mention|contain|include|provide|specify|state|indicate|allow|permit)",
    "(?:is not|are not|was not|isn't|aren't|wasn't) {g}(?:mentioned|stated|specified|provided|available|given|listed|included|found)",
    "(?:lack|lacks|lacking) {g}(?:information|context|data|details)",
    "not {g}(?:mentioned|stated|specified|provided|available|given|listed|included|found)",
    "information provided does not",
    "i (?:don't|do not) (?:know|have)",
)
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}

SPACE = "(?U)[\\s\\x1c-\\x1f]+"
REFUSAL = "(?iU)" + "|".join(p.replace("{g}", GAP) for p in REFUSALS)

CORRECT, HALLUCINATION, ABSTENTION, OTHER = OUTCOMES = ("correct", "hallucination", "abstention", "other")
ATTEMPTED = (CORRECT, HALLUCINATION)


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends; null is empty."""
    return F.regexp_replace(text(c), "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def words(c: Column | str) -> Column:
    """The text's parts between white space of any kind."""
    return F.filter(F.split(text(c), SPACE), lambda w: w != "")


def word_count(c: Column | str, stored: Column | None = None) -> Column:
    """A stored count wins; text that is null is unmeasured, and so null, not 0."""
    c = F.col(c) if isinstance(c, str) else c
    counted = F.when(c.isNotNull(), F.size(words(c)))
    return F.coalesce(stored, counted) if stored is not None else counted


def tokens(c: Column | str) -> Column:
    """Lower case, without ASCII punctuation and articles."""
    bare = F.translate(F.lower(text(c)), PUNCTUATION, "")
    return F.filter(F.split(bare, SPACE), lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalize(c: Column | str) -> Column:
    return F.array_join(tokens(c), " ")


def exact_match(pred: Column | str, gold: Column | str) -> Column:
    return (normalize(pred) == normalize(gold)).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1_of_tokens(p: Column, g: Column) -> Column:
    """Harmonic mean of precision and recall of two token lists, as multisets; 0 if they share none.

    One pass over both lists sorted together: of equal tokens those of the
    first list come before, and each of the second uses one up.
    """
    marked = F.array_sort(F.concat(F.transform(p, lambda t: F.struct(t.alias("t"), F.lit(0).alias("side"))), F.transform(g, lambda t: F.struct(t.alias("t"), F.lit(1).alias("side")))))
    nothing = F.struct(F.lit("").alias("t"), F.lit(0).alias("open"), F.lit(0).alias("both"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        left = F.when(s["t"] == x["t"], s["open"]).otherwise(0)
        used = (x["side"] == 1) & (left > 0)
        return F.struct(
            x["t"].alias("t"), F.when(x["side"] == 0, left + 1).when(used, left - 1).otherwise(left).alias("open"),
            (s["both"] + used.cast("int")).alias("both"), (s["n"] + 1).alias("n"))

    return F.aggregate(marked, nothing, step, lambda s: F.when(s["both"] == 0, F.lit(0.0)).otherwise(2.0 * s["both"] / s["n"]))


def token_f1(pred: Column | str, gold: Column | str) -> Column:
    return f1_of_tokens(tokens(pred), tokens(gold))


def is_abstention(answer: Column | str) -> Column:
    """The text declines somewhere. Empty and null are not abstentions."""
    return text(answer).rlike(REFUSAL)


def opens_with_refusal(answer: Column | str) -> Column:
    head = F.substring(strip(answer), 1, REFUSAL_HEAD)
    return F.regexp_instr(head, F.lit(REFUSAL)).between(1, REFUSAL_LEAD + 1)


def refuses_in_head(answer: Column | str) -> Column:
    return F.substring(strip(answer), 1, REFUSAL_HEAD).rlike(REFUSAL)


def is_compliant_abstention(answer: Column | str) -> Column:
    return strip(answer).startswith(F.lit(SENTINEL))


def classify_outcome(answer: Column | str, score: Column, finish_reason: Column | None = None, threshold: Column | float = THRESHOLD) -> Column:
    """One of four outcomes; the order of the tests is their meaning."""
    cut = F.coalesce(finish_reason == "length", F.lit(False)) if finish_reason is not None else F.lit(False)
    return (
        F.when(strip(answer) == "", OTHER)
        .when(is_compliant_abstention(answer), ABSTENTION)
        .when(opens_with_refusal(answer), OTHER)
        .when(F.coalesce(score, F.lit(0.0)) >= threshold, CORRECT)
        .when(cut, OTHER)
        .when(refuses_in_head(answer), OTHER)
        .otherwise(HALLUCINATION)
    )


def classify_three(abstained: Column, score: Column, threshold: Column | float = THRESHOLD) -> Column:
    return F.when(abstained, "abstained").when(score >= threshold, "correct").otherwise("wrong")


def is_attempted(outcome: Column | str) -> Column:
    return F.coalesce((F.col(outcome) if isinstance(outcome, str) else outcome).isin(*ATTEMPTED), F.lit(False))


def boolean_of(c: Column | str) -> Column:
    """What yes or no the text asserts: by its first token, else by any; null for neither."""
    t = tokens(c)
    first = F.get(t, F.lit(0))
    any_of = lambda values: F.arrays_overlap(t, F.array(*[F.lit(v) for v in values]))
    return F.when(first.isin(*YES), True).when(first.isin(*NO), False).when(any_of(YES), True).when(any_of(NO), False)


def boolean_match(pred: Column | str, gold: Column | str) -> Column:
    return F.coalesce(boolean_of(pred) == boolean_of(gold), F.lit(False)).cast("double")


def years(c: Column | str) -> Column:
    found = F.regexp_extract_all(text(c), F.lit("(?U)\\b(1\\d{3}|20\\d{2})\\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda y: y.cast("int")))


def _month(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.element_at(table, c)


def _numbered_date(z: Column) -> Column:
    return F.struct(z["y"].cast("int").alias("y"), z["m"].cast("int").alias("m"), z["d"].cast("int").alias("d"))


def _named_date(z: Column) -> Column:
    return F.struct(z["y"].cast("int").alias("y"), _month(z["m"]).alias("m"), z["d"].cast("int").alias("d"))


def full_dates(c: Column | str) -> Column:
    """Distinct structs (y, m, d) of ISO dates and of dates with the month's name, either order."""
    low, names = F.lower(text(c)), "|".join(MONTHS)
    forms = (
        (text(c), "(?U)\\b(\\d{4})-(\\d{2})-(\\d{2})\\b", (1, 2, 3), False),
        (low, f"(?U)\\b({names})\\.?\\s+(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s+(\\d{{4}})\\b", (3, 1, 2), True),
        (low, f"(?U)\\b(\\d{{1,2}})(?:st|nd|rd|th)?\\s+({names})\\.?,?\\s+(\\d{{4}})\\b", (3, 2, 1), True),
    )
    parts = []
    for source, pattern, (y, m, d), named in forms:
        group = lambda i, s=source, p=pattern: F.regexp_extract_all(s, F.lit(p), F.lit(i))
        zipped = F.arrays_zip(group(y).alias("y"), group(m).alias("m"), group(d).alias("d"))
        parts.append(F.transform(zipped, _named_date if named else _numbered_date))
    return F.array_distinct(F.concat(*parts))


def date_match(pred: Column | str, gold: Column | str) -> Column:
    """Gold YYYY or YYYY-MM-DD: the full date, or its year without another full date of that year. Other golds: token F1."""
    form = "(?U)^\\s*(\\d{4})(?:-(\\d{2})-(\\d{2}))?\\s*$"
    g = text(gold)
    year, month = F.regexp_extract(g, form, 1).try_cast("int"), F.regexp_extract(g, form, 2)
    full = month != ""
    part = lambda i: F.regexp_extract(g, form, i).try_cast("int")
    wanted = F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))
    dates = full_dates(pred)
    has_full = full & F.exists(dates, lambda d: (d["y"] == wanted["y"]) & (d["m"] == wanted["m"]) & (d["d"] == wanted["d"]))
    rival = full & F.exists(dates, lambda d: d["y"] == year)
    has_year = F.array_contains(years(pred), year)
    return F.when(~g.rlike(form), token_f1(pred, gold)).when(has_full, 1.0).when(has_year & ~rival, 1.0).otherwise(0.0)


def padded(t: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))


def span_index(hay: Column, needle: Column) -> Column:
    """First token index of a run of tokens in another list, -1 if there is none."""
    at = F.instr(padded(hay), padded(needle))
    before = F.substring(padded(hay), F.lit(1), at)
    return F.when((F.size(needle) == 0) | (at == 0), -1).otherwise(F.length(before) - F.length(F.translate(before, " ", "")) - 1)


def contains_span(hay: Column | str, needle: Column | str) -> Column:
    h, n = tokens(hay), tokens(needle)
    return (F.size(n) > 0) & F.contains(padded(h), padded(n))


def rivals(golds: Column, entities: Column) -> Column:
    """The question's other candidates, if one of its entities is the gold; else none."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), normalize), lambda x: x != "")
    g, e = clean(golds), clean(entities)
    return F.when(F.arrays_overlap(g, e), F.filter(e, lambda x: ~F.array_contains(g, x))).otherwise(F.array().cast("array<string>"))


def entity_match(pred: Column | str, gold: Column | str, rival_forms: Column | None = None) -> Column:
    """The gold is a run of the prediction's tokens, and no rival occurs before it."""
    p, g = tokens(pred), tokens(gold)
    at = F.instr(padded(p), padded(g))
    found = (F.size(g) > 0) & (at > 0)
    if rival_forms is None:
        return found.cast("double")
    gold_form = F.array_join(g, " ")
    earlier = F.exists(rival_forms, lambda r: (r != "") & (r != gold_form) & F.instr(padded(p), F.concat(F.lit(" "), r, F.lit(" "))).between(1, at - 1))
    return (found & ~earlier).cast("double")


def split_set(pred: Column | str) -> Column:
    """The items of a list in prose."""
    parts = F.split(text(pred), "(?iU)[,;\\n]|\\band\\b|&")
    items = F.transform(parts, lambda p: strip(F.regexp_replace(p, "(?U)^\\s*(?:[-*•]|\\d+[.)])\\s*", "")))
    return F.filter(items, lambda p: normalize(p) != "")


def gold_in_context(context: Column | str, forms: Column, answer_type: Column | str) -> Column:
    """Whether a gold form stands in a context; a date also by a shared year. Null where that means nothing."""
    kind = F.col(answer_type) if isinstance(answer_type, str) else answer_type
    wanted = F.filter(F.transform(forms, normalize), lambda f: f != "")
    inside = F.exists(wanted, lambda f: F.contains(padded(tokens(context)), F.concat(F.lit(" "), f, F.lit(" "))))
    by_year = F.exists(forms, lambda f: F.arrays_overlap(years(f), years(context)))
    return F.when((kind == "boolean") | (F.size(wanted) == 0), F.lit(None).cast("boolean")).otherwise(inside | ((kind == "date") & by_year))


LINE = "^\\[(.*?)\\] ([^:]+): (.*)$"


def parse_line(line: Column | str) -> Column:
    """A rendered statement as struct(subject, property, value), the value without trailing qualifiers; null if it isn't one."""
    c = F.col(line) if isinstance(line, str) else line
    part = lambda i: F.regexp_extract(c, LINE, i)
    return F.when(c.rlike(LINE), F.struct(part(1).alias("subject"), part(2).alias("property"), strip_qualifiers(part(3)).alias("value")))


def strip_qualifiers(value: Column) -> Column:
    return strip(F.regexp_replace(value, "\\s*\\([^()]*\\)\\s*$", ""))


def strip_reasoning(c: Column | str) -> Column:
    """Without <think> blocks, closed or not."""
    return strip(F.regexp_replace(F.regexp_replace(text(c), "(?is)<think>.*?</think>", ""), "(?is)<think>.*$", ""))


def score_band(score: Column) -> Column:
    return F.when(score >= 1, "full").when(score <= 0, "zero").when(score.isNotNull(), "partial")


def human_score(claims: Column) -> Column:
    """Share of supported among the valid ones of claims struct(valid, supported); null until all are annotated."""
    valid = F.filter(claims, lambda c: c["valid"])
    complete = F.forall(claims, lambda c: c["valid"].isNotNull() & (~c["valid"] | c["supported"].isNotNull()))
    return F.when(complete & (F.size(valid) > 0), F.size(F.filter(valid, lambda c: c["supported"])) / F.size(valid))


def starts_with_any(c: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])
