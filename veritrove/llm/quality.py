"""Quality rules: a threshold table compiled into one native projection.

Each document's figures (lengths, symbols, stop words, lines, repeats) are
Catalyst expressions over the text, and a table of (name, expression, low,
high) rules is compiled into further columns of the same projection. There is
no user function, no join and no shuffle: the plan is scan -> project.

Defined cases: a null text counts as empty (no words, fails the base test);
a text of separators only is the same; repeated rows give repeated results;
columns of the input are read by name and only id and text are touched, so
other columns, whatever their names, neither clash nor pass through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "the of and to in that with for is was be it as by on are this from at or an have not "
    "der die das und ist nicht von mit den dem ein eine zu auf für als auch im des sich "
    "le la les de des et un une que qui dans pour par sur est pas au avec "
    "el los las una del por con para como más se no su al lo"
).split()

SEPARATORS = " \t\n\x0b\x0c\r"


class Rule(NamedTuple):
    """A document passes if low <= over / under <= high; None leaves a side open.

    A document without anything to divide by has the ratio 0.
    """

    name: str
    over: str
    under: str
    low: float | None
    high: float | None

    def sql(self) -> str:
        ratio = f"coalesce(try_divide(cast({self.over} as double), {self.under}), 0d)"
        sides = [f"{ratio} >= {self.low}"] if self.low is not None else []
        sides += [f"{ratio} <= {self.high}"] if self.high is not None else []
        return " and ".join(sides) or "true"


#: The production thresholds, over the figures below.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", "1", 2.0, None),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def same(step: str) -> str:
    """SQL: whether the window g at place k of the sorted ones equals the one `step` further."""
    words = " and ".join(f"get(_w, cast(g & _m as int) + {j}) = get(_w, cast(get(_g, k + {step}) & _m as int) + {j})" for j in range(3))
    return f"coalesce((g | _m) = (get(_g, k + {step}) | _m) and {words}, false)"


def figures(text: str) -> list[tuple[str, str]]:
    """(name, SQL) of each figure, in an order in which later ones may use earlier ones."""
    seps = "\\t\\n\\u000b\\u000c\\r "
    both_cases = sorted({v for w in STOP_WORDS for v in (w, w.capitalize(), w.upper())})
    return [
        ("_t", f"trim(both '{seps}' from coalesce({text}, ''))"),
        ("_w", "if(_t = '', cast(array() as array<string>), split(_t, '[ \\\\x09-\\\\x0D]+'))"),
        ("n_words", "cast(size(_w) as bigint)"),
        ("word_chars", f"cast(length(translate(_t, '{seps}', '')) as bigint)"),
        ("n_symbols", "cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as bigint)"),
        ("n_stop_words", f"cast(size(filter(_w, w -> w in ({_quoted(both_cases)}))) as bigint)"),
        ("_l", f"filter(split({text}, '\\n'), l -> trim(both '{seps}' from l) <> '')"),
        ("n_lines", "cast(coalesce(size(_l), 0) as bigint)"),
        ("n_dup_lines", "cast(coalesce(size(_l) - size(array_distinct(_l)), 0) as bigint)"),
        # Windows of three words: the high bits of a hash over the place in the text. Sorted as
        # longs, equal windows are neighbours; neighbours of one hash are compared word by word.
        ("_m", "shiftleft(1L, cast(ceil(log2(n_words + 1)) as int)) - 1"),
        ("_g", "sort_array(transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> "
               "xxhash64(w, get(_w, i + 1), get(_w, i + 2)) & ~_m | i))"),
        ("_r", f"sort_array(transform(filter(_g, (g, k) -> {same('1')} or {same('-1')}), g -> g & _m))"),
        # Words that windows at sorted places cover: three each, less what overlaps the one before.
        ("n_repeat_words", "coalesce(aggregate(transform(_r, (p, k) -> if(k = 0, 3L, least(3L, p - get(_r, k - 1)))), 0L, (s, x) -> s + x), 0L)"),
    ]


def quality(documents: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each input row: the id, the figures, each rule's verdict, base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in three-word
    windows that occur twice or more in the text. kept: not base_failed, and
    every rule of the table holds.
    """
    out = documents.select(F.col(id_column), F.col(text_column).alias("_text"))
    hidden = ["_text"]
    for name, sql in figures("_text"):
        out = out.withColumn(name, F.expr(sql))
        hidden += [name] if name[0] == "_" else []
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    kept = ~F.col("base_failed")
    for r in rules:
        out = out.withColumn(f"ok_{r.name}", F.expr(r.sql()))
        kept = kept & F.col(f"ok_{r.name}")
    return out.withColumn("kept", kept).drop(*hidden)
