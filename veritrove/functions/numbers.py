"""Number phrases and set answers: the two matchers with state, as Arrow functions.

Both are vectorised over Arrow batches; only the phrase grammar and the greedy
matching run in Python. Rows without a digit or number word never reach them.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .text import ARTICLES, PUNCTUATION, text

# Number words.
UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6,
    "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}

# How digits and words are written, what may stand inside a phrase, and the word that never ends one.
LEXEMES = r"(-?\d[\d,]*(?:\.\d+)?)|([a-z]+)|((?:[ \t\r\n]|-(?!\d))+)|."
LINK = "and"

_LEXEME = re.compile(LEXEMES, re.DOTALL)
#: A lexeme's letter in a phrase's shape: d digits, o digits that are 0, u units, z zero, T ten and more, h hundred, s scales.
_LETTERS = (
    {w: ("u" if 0 < v < 10 else "T" if v else "z", float(v)) for w, v in {**UNITS, **TENS}.items()}
    | {w: ("s", float(v)) for w, v in SCALES.items()}
    | {"hundred": ("h", 100.0)}
)
#: A term of a quantity: a value, a scale, or both. Zeros before a value are no value yet; digits only begin one.
_TERM = re.compile("[zo]*(?:d|u|T[uz]?)?(?:h+(?:T[uz]?|[uz])?)*s?")


def phrases(source: str) -> list[tuple[str, list[float]]]:
    """Runs of number lexemes, each as its shape and the lexemes' amounts; any other word or mark ends a run."""
    runs: list[tuple[str, list[float]]] = [("", [])]
    for digits, word, gap in _LEXEME.findall(source.lower()):
        if digits:
            amount = float(digits.replace(",", ""))
            letter = "d" if amount else "o"
        elif word in _LETTERS:
            letter, amount = _LETTERS[word]
        elif gap or word == LINK:
            continue
        else:
            runs.append(("", []))
            continue
        shape, amounts = runs[-1]
        runs[-1] = (shape + letter, [*amounts, amount])
    return [r for r in runs if r[0]]


def terms(shape: str, amounts: list[float]) -> list[tuple[float, float]]:
    """(value, scale) of each term of a phrase; the scale of a bare value is 1."""
    out = []
    for m in _TERM.finditer(shape):
        value = 0.0
        for letter, amount in zip(m[0].rstrip("s"), amounts[m.start() : m.end()], strict=False):
            value = (value or 1.0) * amount if letter == "h" else value + amount
        if m[0].endswith("s"):
            out.append((value or 1.0, amounts[m.end() - 1]))
        elif m[0]:
            out.append((value, 1.0))
    return out


def parse_numbers(source: str | None) -> list[float]:
    """The quantities of a text in order: sums of neighbouring terms while their scales descend."""
    out: list[float] = []
    for shape, amounts in phrases(source or ""):
        before = 0.0
        for value, scale in terms(shape, amounts):
            if scale < before:
                out[-1] += value * scale
            else:
                out.append(value * scale)
            before = scale
    return [round(x, 6) for x in out]


@F.pandas_udf(ST.ArrayType(ST.DoubleType()))
def _numbers(texts: pd.Series) -> pd.Series:
    return texts.map(parse_numbers)


def numbers(c: Column | str) -> Column:
    """The quantities of a text. Texts without any digit or number word are decided in the JVM."""
    t = text(c)
    may = t.rlike("(?i)[0-9]|" + "|".join([*UNITS, *TENS, "hundred", *SCALES]))
    return F.when(may, _numbers(F.when(may, t))).otherwise(F.array().cast("array<double>"))


@F.pandas_udf(ST.ArrayType(ST.ArrayType(ST.DoubleType())))
def _numbers_of_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: None if texts is None else [parse_numbers(t) for t in texts])


def numbers_of_each(texts: Column) -> Column:
    """The quantities of each text of a list."""
    return _numbers_of_each(texts)


def numeric_match(pred_numbers: Column, gold_numbers: Column) -> Column:
    """Every number of the gold is among the prediction's, and it has one."""
    return ((F.size(gold_numbers) > 0) & (F.size(F.array_except(gold_numbers, pred_numbers)) == 0)).cast("double")


def as_number(c: Column | str) -> Column:
    """A number as written on its own: groups parted by comma, space or no-break space; several points are groups too."""
    bare = F.regexp_replace(text(c), "[,\\s\\u00a0\\u202f]", "")
    points = F.length(bare) - F.length(F.translate(bare, ".", ""))
    return F.when(points > 1, F.translate(bare, ".", "")).otherwise(bare).try_cast("double")


# What parts the items of a list in prose, a list mark before an item, the least token F1 of a match.
ITEM_BREAK = r"[,;\n]|\band\b|&"
LIST_MARK = r"^\s*(?:[-*•]|\d+[.)])\s*"
LEAST_F1 = 0.5

_BREAK, _MARK = re.compile(ITEM_BREAK, re.IGNORECASE), re.compile(LIST_MARK)
_BARE = {ord(c): None for c in PUNCTUATION}


def bare_words(s: str) -> list[str]:
    return [w for w in s.lower().translate(_BARE).split() if w not in ARTICLES]


def bag_f1(a: Counter[str], b: Counter[str]) -> float:
    """Token F1 of two multisets."""
    return 2 * (a & b).total() / max(1, a.total() + b.total())


def said_whole(text: str, member: str) -> tuple[str, int]:
    """The text without a member that an item break would part, and how often it was said."""
    if not _BREAK.search(member):
        return text, 0
    return re.subn(r"\s+".join(re.escape(w) for w in member.split()), ";", text, flags=re.IGNORECASE)


def assigned(items: list[Counter[str]], golds: list[Counter[str]]) -> int:
    """Items that get a member of their own: each in turn takes the closest that is left, of equal ones the later."""
    free = list(range(len(golds)))
    for item in items:
        ranked = sorted((bag_f1(item, golds[g]), g) for g in free)
        if ranked and ranked[-1][0] >= LEAST_F1:
            free.remove(ranked[-1][1])
    return len(golds) - len(free)


def set_scores(pred: str | None, members: list[str] | None) -> dict[str, float]:
    """Precision, recall and F1 of the items of an answer against a gold set, matched one to one.

    Members that an item break would part are looked for as a whole first. An
    item said twice counts against precision and matches nothing.
    """
    golds = [] if members is None else list(members)
    rest, times = pred or "", []
    for member in golds:
        rest, n = said_whole(rest, member)
        times.append(n)
    items = [tuple(w) for w in (bare_words(_MARK.sub("", part)) for part in _BREAK.split(rest)) if w]
    open_ = [Counter(bare_words(m)) for m, n in zip(golds, times, strict=True) if not n]
    hits = sum(n > 0 for n in times) + assigned([Counter(w) for w in dict.fromkeys(items)], open_)
    claims = sum(times) + len(items)
    p, r = hits / max(1, claims), hits / max(1, len(golds))
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if hits else 0.0, "exact": float(bool(golds) and claims == hits == len(golds))}


@F.pandas_udf(ST.StructType([ST.StructField(c, ST.DoubleType()) for c in ("precision", "recall", "f1", "exact")]))
def set_match(preds: pd.Series, members: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([set_scores(p, m) for p, m in zip(preds, members, strict=True)], columns=["precision", "recall", "f1", "exact"])
