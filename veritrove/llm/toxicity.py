"""Toxic passages by maximum-scoring segment search.

Model. Token log-odds between toxic and clean training texts under an
informative Dirichlet prior (the prior of a token is its share of all training
texts); counts are of texts that hold a token, so that one text can't decide.
Tokens in fewer than LEAST_DOCS toxic texts, and those whose z-score isn't
significant, weigh nothing, and every token pays a small drift, so that clean
text sinks. A linear-time scan over a text's
token weights finds all its maximal scoring segments. Under the clean token
distribution the largest segment follows an extreme-value law: lambda solves
E[exp(lambda * weight)] = 1, K is fitted by maximum likelihood on clean texts,
and a segment of score S in n tokens has E-value K n exp(-lambda S). What a
text's significant segments say together is calibrated to a probability by a
logistic fit on training texts that the token weights haven't seen.

Training reads at most `max_train` labelled rows, the first by a hash of their
id (a documented bound), in two halves by another hash: each half's scores
under the weights of the other give the calibration. Scoring covers every whole text: scan -> Arrow
map, no shuffle.

Defined cases: null and empty texts have no segments and get the probability
of such texts; labels that are null, or of unknown documents, are not used;
repeated rows are scored alike; without any label of a class every text gets
the share of toxic labels, or 0 without labels; other columns pass untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import annotate, discard, sliced, stored
from .words import ALNUM, Words, text_bytes

MAX_TRAIN = 20_000
PRIOR = 1000.0
SIGNIFICANT_Z = 3.0
LEAST_DOCS = 3
DRIFT = 0.05
#: Weight bound, so that one token can't decide beyond all others.
MOST_WEIGHT = 6.0
#: Segments with a smaller E-value are passages.
E_VALUE = 0.05


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    scale: float = 1.0
    k: float = 1.0
    #: Intercept and slopes over features(), and the features' means and deviations.
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(1))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in linear time.

    Each candidate keeps the cumulative score before and at its end, and the
    nearest candidate to its left that starts lower. A new one joins that as
    long as the whole rises above its end; where no candidate starts lower, all
    are final, since nothing later can reach them.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.append(0.0, np.cumsum(scores))
    done: list[tuple[int, int, float, float, int]] = []
    stack: list[tuple[int, int, float, float, int]] = []
    for i, low, high in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist(), strict=True):
        a, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0:
                done += stack
                stack.clear()
                break
            if stack[j][3] >= high:
                break
            a, low = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
        stack.append((a, i + 1, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in done + stack]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds ratio, z-score) of each token's counts under the informative Dirichlet prior."""
    alpha = prior * (toxic + clean) / max(1.0, n_toxic + n_clean)
    a, b = toxic + alpha, clean + alpha
    a, b = np.maximum(a, 1e-9), np.maximum(b, 1e-9)
    delta = np.log(a / np.maximum(n_toxic + prior - a, 1e-9)) - np.log(b / np.maximum(n_clean + prior - b, 1e-9))
    return delta, delta / np.sqrt(1 / np.maximum(a, 1e-9) + 1 / np.maximum(b, 1e-9))


def lambda_of(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of E[exp(lambda w)] = 1 for token weights with given shares."""
    if not len(weights) or weights.max() <= 0 or (weights * shares).sum() >= 0:
        return 1.0
    excess = lambda x: float((shares * np.exp(np.minimum(x * weights, 700))).sum() - 1)
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 100:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def features(found: list[tuple[int, int, float]], n: int, model: Model) -> tuple[float, float, float, float]:
    """What the segments of one text of n tokens say: evidence of the largest and of all, how many, how dense."""
    if not found:
        return 0.0, 0.0, 0.0, 0.0
    evidence = sorted((max(0.0, (model.scale * s - np.log(max(model.k * n, 1e-12))) / np.log(10)) for _, _, s in found), reverse=True)
    some = [e for e in evidence if e > -np.log10(E_VALUE)]
    return min(evidence[0], 30.0), float(np.log1p(sum(some))), float(np.log1p(len(some))), float(np.log1p(100 * len(found) / max(n, 1)))


def scored_rows(texts: pa.Array, model: Model):
    """(segments, tokens, features) of each text."""
    words = Words(texts, ALNUM)
    weights = np.fromiter((model.weights.get(w, 0.0) for w in words.vocab), float, len(words.vocab)) - DRIFT
    flat = weights[words.codes]
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        found = segments(flat[a:b])
        yield found, b - a, features(found, b - a, model)


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    if not len(model.centre):
        return np.full(len(x), model.coefficients[0])
    z = model.coefficients[0] + ((x - model.centre) / model.spread) @ model.coefficients[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x1 = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x1.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def pieces(batches):
    """Batches (anything, text) cut to slices of bounded bytes of text."""
    for batch in batches:
        off, _ = text_bytes(batch.column(1))
        for a, b in sliced(off):
            yield batch.slice(a, b - a)


def _presence(batches):
    """(token, toxic texts, clean texts) of each slice."""
    for batch in pieces(batches):
        words = Words(batch.column(1), ALNUM)
        toxic = np.array(batch.column(0).to_pylist(), bool)
        pairs = np.unique(words.rows() * (len(words.vocab) + 1) + words.codes)
        row, code = pairs // (len(words.vocab) + 1), pairs % (len(words.vocab) + 1)
        t = np.bincount(code[toxic[row]], minlength=len(words.vocab))
        c = np.bincount(code[~toxic[row]], minlength=len(words.vocab))
        yield pa.RecordBatch.from_arrays([pa.array(words.vocab, pa.binary()), pa.array(t, pa.int64()), pa.array(c, pa.int64())], names=["token", "toxic", "clean"])


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fits on labelled documents; `labels` holds the rows that may be learnt from."""
    # The sample is bounded, so it can be broadcast; equal texts count once.
    sample = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = (
        documents.select(F.col(id_column).alias("_i"), text.alias("_t")).join(F.broadcast(sample), F.col("_i") == F.col("_id"))
        .groupBy(F.xxhash64("_t").alias("_h"), F.length("_t").alias("_n")).agg(F.min_by("_t", "_i").alias("text"), (F.max("_y") > 0).alias("toxic"))
        .withColumn("half", F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(2)))
    )
    rows = stored(rows, "sample")
    both = None
    for half in (0, 1):
        one = rows.where(F.col("half") == half).select("toxic", "text").mapInArrow(_presence, "token binary, toxic bigint, clean bigint")
        one = one.select("token", *[(F.col(c) if h == half else F.lit(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "clean")])
        both = one if both is None else both.unionByName(one)
    names = ["toxic0", "clean0", "toxic1", "clean1"]
    counts = both.groupBy("token").agg(*[F.sum(c).alias(c) for c in names])
    kept = counts.where((F.col("toxic0") + F.col("toxic1") >= LEAST_DOCS) | (F.col("clean0") + F.col("clean1") >= 20)).collect()
    n = {(r.half, bool(r.toxic)): r.n for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    tokens = [bytes(r.token) for r in kept]
    table = np.array([[r[c] for c in names] for r in kept], float).reshape(-1, 4)
    of = lambda h, toxic: float(n.get((h, toxic), 0))
    model = Model()
    model.coefficients = np.array([(of(0, True) + of(1, True)) / max(1, sum(n.values()))])
    if not len(tokens) or not (of(0, True) + of(1, True)) or not (of(0, False) + of(1, False)):
        return model

    def weighed(t: np.ndarray, c: np.ndarray, n_toxic: float, n_clean: float) -> Model:
        m = Model()
        delta, z = log_odds(t, c, n_toxic, n_clean, PRIOR * min(1.0, (n_toxic + n_clean) / 10_000))
        use = (np.abs(z) >= SIGNIFICANT_Z) & ((t >= LEAST_DOCS) | (delta < 0))
        m.weights = {w: float(np.clip(d, -1.0, MOST_WEIGHT)) for w, d, u in zip(tokens, delta, use, strict=True) if u}
        m.scale = lambda_of(np.array([m.weights.get(w, 0.0) for w in tokens]) - DRIFT, (c + 0.5) / (c + 0.5).sum())
        return m

    # Each half is calibrated under the weights of the other; the final weights come from both.
    model = weighed(table[:, 0] + table[:, 2], table[:, 1] + table[:, 3], of(0, True) + of(1, True), of(0, False) + of(1, False))
    x, y, ks = [], [], []
    for half in (0, 1):
        m = weighed(table[:, 2 - 2 * half], table[:, 3 - 2 * half], of(1 - half, True), of(1 - half, False))
        held = rows.where(F.col("half") == half).select("toxic", "text")
        clean = [(r.n, r.best) for r in _measured(held.where("not toxic"), m, "n bigint, best double").where("n > 0").collect()]
        m.k = max(1e-9, len(clean) / max(1e-9, sum(a * float(np.exp(-min(m.scale * s, 700.0))) for a, s in clean))) if clean else 1.0
        ks.append(m.k)
        for r in _measured(held, m, "toxic boolean, x array<double>").collect():  # five numbers for each of at most max_train texts
            x.append(r.x)
            y.append(float(r.toxic))
    model.k = float(np.exp(np.mean(np.log(ks))))
    x, y = np.array(x).reshape(-1, 4), np.array(y)
    discard(rows)
    model.centre, model.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.coefficients = _logistic((x - model.centre) / model.spread, y)
    return model


def _measured(rows: DataFrame, model: Model, schema: str) -> DataFrame:
    """Of each (toxic, text): toxic, n (tokens), best (the largest segment's score) and x (features), as `schema` asks."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in pieces(batches):
            found = list(scored_rows(batch.column(1), model))
            columns = {
                "toxic": batch.column(0), "n": pa.array([n for _, n, _ in found], pa.int64()),
                "best": pa.array([max((s for _, _, s in f), default=0.0) for f, _, _ in found], pa.float64()), "x": pa.array([list(x) for _, _, x in found], pa.list_(pa.float64())),
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return rows.mapInArrow(run, schema)


FIELDS = "score double, n_words bigint, passages array<struct<start:bigint,stop:bigint,score:double,e_value:double>>"


def toxicity(documents: DataFrame, model: Model, keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """Each row: row (struct of `keep`, all columns by default) and found: score, n_words and the significant passages (word ranges)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(texts):
            rows = list(scored_rows(texts, m))
            p = probability(np.array([x for _, _, x in rows]).reshape(-1, 4), m)
            passages = []
            for found, n, _ in rows:
                e = [(a, b, s, float(m.k * n * np.exp(-min(m.scale * s, 700.0)))) for a, b, s in found]
                passages.append([{"start": a, "stop": b, "score": s, "e_value": v} for a, b, s, v in e if v < E_VALUE])
            return [p, [n for _, n, _ in rows], passages]

        return f

    return annotate(documents, text_column, list(keep or documents.columns), make, FIELDS)


def remainder(column: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(by))
