"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule w(t) over training time t in [0, 1], given
by its values at the start and the end and linear between. Its integral is the
source's share. Shares of sources that would be repeated more than
`max_repeats` times are cut there and the rest is dealt anew by weight.

A source's documents stand in a pseudo-random order that depends on ids only,
on texts where there is none (reruns agree), and are passed through again and again until the
source's target is used up. The words before a document's copy, those of the
passes before it included, are the cumulative demand at which it is wanted;
inverting the integral of the schedule gives the training time, and so the
position of each copy. A range sort by position gives the training order.

Prefix sums over a source are taken in two levels - buckets of the order, then
rows of a bucket - so that a source that holds most rows is many tasks.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; empty documents are taken zero words; a source of size 0 has
target 0; an empty table gives an empty result; repeated rows are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Slope of the schedules: source k starts at (1 + s) and ends at (1 - s) times its weight, s cycling.
SLOPES = (0.5, 0.0, -0.5)
MAX_REPEATS = 3.0
#: Rows of one bucket of the order, all sources together.
BUCKET_ROWS = 4096
#: A table of bucket sums up to this many rows (of some 60 bytes) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def n_words(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def water_fill(rows: list[tuple[object, float, int]], total: float, most: float) -> dict[object, float]:
    """Targets by source: shares of total by weight, none above most times its size."""
    target, open_ = {}, {s: (w, n) for s, w, n in rows}
    left = total
    while open_:
        weights = sum(w for w, _ in open_.values())
        full = {s: most * n for s, (w, n) in open_.items() if left * w / weights >= most * n} if weights else {s: 0.0 for s in open_}
        if not full:
            target |= {s: left * w / weights for s, (w, _) in open_.items()}
            break
        target |= full
        left -= sum(full.values())
        for s in full:
            del open_[s]
    return target


def source_targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, slopes=SLOPES, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """Columns source, rank, weight, slope, source_size, target from a table of (source, source_size).

    Water-filling without loops: with sources ordered by size / weight, those
    that are full are a prefix of the order. It ends at the first source whose
    cap isn't reached by its share of what the ones before leave.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    k, s = len(weights), len(slopes)
    rank = F.row_number().over(by_name) - 1
    pick = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i % len(values) + 1).cast("int"))
    t = sizes.withColumn("rank", rank).withColumn("weight", pick(weights, F.col("rank"))).withColumn("slope", pick(slopes, F.col("rank")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_before", F.coalesce(F.sum("source_size").over(by_cap), F.lit(0)) * F.lit(float(max_repeats)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_weights"))
        .withColumn("_full", F.col("weight") * F.col("_level") >= F.lit(float(max_repeats)) * F.col("source_size"))
    )
    # The level at the first source that isn't full holds for all after it.
    level = F.min_by(F.when(~F.col("_full"), F.col("_level")), F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("weight"), "rank"))).over(everything)
    t = t.withColumn("_final", level)
    return t.withColumn(
        "target",
        F.when(F.col("_final").isNull(), F.lit(float(max_repeats)) * F.col("source_size"))
        .otherwise(F.least(F.lit(float(max_repeats)) * F.col("source_size"), F.col("weight") * F.col("_final"))),
    ).select(source, "rank", "weight", "slope", "source_size", "target")


def training_time(u: Column, slope: Column) -> Column:
    """Inverse of the share U(t) = t (1 + s) - s t^2 of a source's demand by time t; s in [-1, 1]."""
    a = 1.0 + slope
    root = F.sqrt(F.greatest(a * a - 4.0 * slope * u, F.lit(0.0)))
    return 2.0 * u / (a + root)


def shuffled(name: Column, seed: int) -> Column:
    """60 bits of a digest of a name and a seed."""
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 15), 16, 10).cast("bigint")


def mixed(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          keep: list[str] | None = None, weights=WEIGHTS, slopes=SLOPES, max_repeats: float = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """Each document once: row (struct of `keep`), size, source_size, target, taken, position, positions.

    taken: words the mix takes from the document, whole passes and the last
    partial one together. position: training time in [0, 1] of its first copy,
    null if none is taken. positions: the training time of each copy; a last
    partial copy counts as whole if it is over half of the document.
    """
    keep = list(keep or documents.columns)
    n_buckets = max(1, -(-documents.count() // BUCKET_ROWS))
    base = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(source_column).alias("_source"),
        n_words(F.col(text_column)).alias("size"),
        shuffled(F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(text_column, F.lit(""))))), seed).alias("_order"),
        F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_tie"),
    ).withColumn("_bucket", F.least(F.floor(F.col("_order") / F.lit(float(1 << 60)) * n_buckets), F.lit(n_buckets - 1)))
    sums = stored(base.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum")), "sums")
    per_source = sums.groupBy("_source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(per_source, "_source", weights, slopes, max_repeats)
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    info = starts.alias("b").join(targets.alias("t"), F.col("b._source").eqNullSafe(F.col("t._source"))).select(
        F.col("b._source").alias("_s"), F.col("b._bucket").alias("_b"), "_start", "slope", "source_size", "target"
    )
    if sums.count() <= BROADCAST_ROWS:
        info = F.broadcast(info)
    placed = base.join(info, base["_source"].eqNullSafe(info["_s"]) & (base["_bucket"] == info["_b"])).drop("_s", "_b")
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_at", F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    want = F.round(F.col("target")).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = want - passes * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_at")))
    taken = (passes * F.col("size") + partial).cast("bigint")

    def position(copy: Column) -> Column:
        share = F.when(want > 0, F.least(F.lit(1.0), (F.col("_at") + copy * F.col("source_size")) / want)).otherwise(F.lit(0.0))
        return training_time(share, F.col("slope"))

    # Copies are numbered from 0: as many passes come before each.
    copies = F.when(F.col("size") > 0, F.floor(taken / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    numbers = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    return placed.select(
        "row", "size", "source_size", "target", taken.alias("taken"),
        F.when(taken > 0, position(F.lit(0))).alias("position"), F.transform(numbers, position).alias("positions"),
    )


def curriculum(documents: DataFrame, **options) -> DataFrame:
    """The training order: every copy of every document that the mix takes, all columns, sorted by the copy's position."""
    m = mixed(documents, **options)
    return m.select("row", F.posexplode("positions").alias("_copy", "_position")).orderBy("_position", "_copy").select("row.*")
