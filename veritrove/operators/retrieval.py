"""Retrieval: entity keys to statements or text windows, deduplicated, ranked and rendered."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statements as S
from ..functions.text import normalize, words

CHUNK_WORDS, CHUNK_OVERLAP = 300, 50
INCOMING_CAP = 30
MOST_ALIASES = 8


def windows_of(w: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of `size` words that overlap, joined by spaces; the last one is the first that reaches the end.

    w should be a column of its own: an expression would be evaluated anew for each window.
    """
    step, n = size - overlap, F.size(w)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step) * step).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))


def windows(text: Column | str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """The windows of a text, white space collapsed."""
    return windows_of(words(text), size, overlap)


def chunks(articles: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """One row for each window: key, index, n_chunks, text."""
    split = articles.select(F.col(key).alias("source_entity_id"), *([F.col(title).alias("title")] if title else []), words(text).alias("_words"))
    w = split.withColumn("_w", windows_of(F.col("_words"))).drop("_words")
    return w.select(*[c for c in w.columns if c != "_w"], F.size("_w").alias("n_chunks"), F.posexplode("_w").alias("index", "text"))


def fold_statements(bindings: DataFrame) -> DataFrame:
    """Rows of statement x qualifier into statements with sorted qualifiers.

    Bindings: statement_id, subject_id, subject_label, property_id,
    property_label, value (snak), rank, direction, source_entity_id, qualifier
    (struct or null). Scalars depend on the statement alone, so any row gives them.
    """
    scalars = [c for c in bindings.columns if c not in ("statement_id", "qualifier")]
    kept = F.filter(F.collect_list("qualifier"), lambda q: q["property_label"].isNotNull() & (q["property_label"] != "") & ~q["property_label"].rlike("^P\\d+$") & q["value"]["label"].isNotNull())
    folded = bindings.groupBy("statement_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in scalars], S.sorted_qualifiers(kept).alias("qualifiers"))
    readable = (F.coalesce(F.col("property_label"), F.lit("")) != "") & (F.coalesce(F.col("subject_label"), F.lit("")) != "")
    return folded.where(readable & ~(F.col("value.label").isNull() & (F.col("value.snaktype") == "value")))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def cap(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def clean_statements(statements: DataFrame, mode: str = "property_type", policy=S.RANKS, incoming_cap: int = INCOMING_CAP) -> DataFrame:
    """Whole-record duplicates, ranks, bookkeeping properties and qualifiers go; incoming statements are capped by property label.

    The cap counts what the filters leave, in order of statement_id.
    """
    kept = statements.dropDuplicates().where(S.rank_kept(F.col("rank"), policy) & ~S.is_noise(F.col("property_label"), F.col("value.datatype"), mode))
    order = Window.partitionBy("source_entity_id", "direction", "property_label").orderBy("statement_id")
    capped = kept.withColumn("_rn", F.row_number().over(order)).where((F.col("direction") == "outgoing") | (F.col("_rn") <= incoming_cap)).drop("_rn")
    return capped.withColumn("qualifiers", F.filter("qualifiers", lambda q: ~S.is_noise(q["property_label"], q["value"]["datatype"], mode)))


def forward(statements: DataFrame, keys: DataFrame, key: str, most: int) -> DataFrame:
    """Outgoing statements of the given keys, at most so many each, and whether the limit was reached."""
    found = statements.join(keys.select(F.col(key).alias("subject_id")).distinct(), "subject_id", "left_semi")
    w = Window.partitionBy("subject_id")
    return found.withColumn("_rn", F.row_number().over(w.orderBy("statement_id"))).withColumn("truncated", F.count(F.lit(1)).over(w) >= most).where(F.col("_rn") <= most).drop("_rn")


def forward_bindings(statements: DataFrame, qualifiers: DataFrame, value_nodes: DataFrame, labels: DataFrame, keys: DataFrame, key: str, most: int, languages: tuple[str, ...] = ("en", "mul")) -> DataFrame:
    """One row for each statement of a key and qualifier of it, with unit and precision of its value node and labels by language.

    statements: statement_id, subject_id, property_id, value_id, rank;
    qualifiers: statement_id, qualifier_id, qualifier_value; value_nodes:
    statement_id, unit, precision; labels: id, lang, label - the first language
    that has one wins. truncated says that a key has `most` rows or more.
    """
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    named = labels.where(F.col("lang").isin(*languages)).groupBy(F.col("id").alias("_l")).agg(F.min_by("label", F.element_at(place, F.col("lang"))).alias("_label"))
    rows = statements.join(keys.select(F.col(key).alias("subject_id")).distinct(), "subject_id", "left_semi").join(qualifiers, "statement_id", "left").join(value_nodes, "statement_id", "left")
    for c, out in (("subject_id", "subject_label"), ("property_id", "property_label"), ("value_id", "value_label")):
        rows = rows.join(named, F.col(c) == F.col("_l"), "left").withColumnRenamed("_label", out).drop("_l")
    w = Window.partitionBy("subject_id")
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy("statement_id", "qualifier_id"))).withColumn("truncated", F.count(F.lit(1)).over(w) >= most)
    return ranked.where(F.col("_rn") <= most).drop("_rn")


def reverse_properties(statements: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Properties by which anything points at the given keys, sorted by number."""
    found = statements.join(keys.select(F.col(key).alias("_k")).distinct(), F.col("value_id") == F.col("_k"), "left_semi").select(F.col("value_id").alias(key), "property_id").distinct()
    return found.orderBy(key, F.substring("property_id", 2, 20).try_cast("int"), "property_id")


def reverse_capped(statements: DataFrame, most: int = INCOMING_CAP) -> DataFrame:
    """Incoming statements, at most so many per (value, property); truncated counts distinct statements, not rows."""
    distinct = statements.select("value_id", "property_id", "statement_id").distinct()
    w = Window.partitionBy("value_id", "property_id")
    ranked = distinct.withColumn("rn", F.row_number().over(w.orderBy("statement_id"))).withColumn("truncated", F.count(F.lit(1)).over(w) >= most)
    return ranked.where(F.col("rn") <= most)


def entity_meta(rows: DataFrame, key: str = "qid") -> DataFrame:
    """Least label and description, sorted distinct aliases, and one step of redirects followed."""
    m = rows.groupBy(key).agg(F.min("label").alias("label"), F.min("description").alias("description"), F.array_sort(F.collect_set("alias")).alias("aliases"), F.min("redirect").alias("redirect"))
    t = m.select(*[F.col(c).alias(f"_{c}") for c in m.columns])
    j = m.join(t, m["redirect"] == t[f"_{key}"], "left")
    return j.select(key, F.coalesce("_label", "label", F.col(key).cast("string")).alias("label"), F.coalesce("_description", "description").alias("description"), F.when(F.col(f"_{key}").isNotNull(), F.col("_aliases")).otherwise(F.col("aliases")).alias("aliases"), "redirect")


def search_entities(entities: DataFrame, name: str, most: int = 5) -> DataFrame:
    """Entities whose label holds a name, exact ones first."""
    wanted = F.lower(F.lit(name))
    return entities.where(F.contains(F.lower("label"), wanted)).orderBy((F.lower("label") == wanted).desc(), F.length("label"), "label").limit(most)


#: Letters of a gram of the index; shorter names have grams of their own length.
GRAM = 3


def search_names(entities: DataFrame, names: DataFrame, entity_id: str = "qid", most: int = 5) -> DataFrame:
    """(name, entity_id, label, rank): for every name the entities whose labels hold it, exact ones first, then short ones, then by label and id.

    An inverted index of grams of letters: each name is looked up by the one of
    its grams that the fewest labels have, and only those labels are compared.
    Letters' case doesn't count; names without letters find nothing.
    """
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, n)))
    asked = names.select("name", F.lower("name").alias("_asked")).where(F.trim("name") != "").distinct()
    asked = asked.select("name", "_asked", F.explode(grams("_asked", F.least(F.lit(GRAM), F.length("_asked")))).alias("_gram"))
    wanted = asked.select(F.col("_gram").alias("_g")).distinct()
    labels = entities.select(F.col(entity_id), "label", F.lower("label").alias("_label")).where("label is not null")
    every = F.array_distinct(F.flatten(F.array(*[grams("_label", F.lit(n)) for n in range(1, GRAM + 1)])))
    posted = labels.select(entity_id, "label", "_label", F.explode(every).alias("_g")).join(wanted, "_g", "left_semi")
    counts = posted.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    # A name one of whose grams no label has is found nowhere.
    rarest = asked.join(counts, F.col("_gram") == F.col("_g"), "left").groupBy("name", "_asked").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_gram").alias("gram"))).alias("_r")).where("_r.df > 0")
    found = rarest.join(posted, F.col("_r.gram") == F.col("_g")).where(F.contains("_label", "_asked"))
    order = Window.partitionBy("name").orderBy((F.col("_label") == F.col("_asked")).desc(), F.length("label"), "label", entity_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("name", entity_id, "label", "rank")


def override_labels(statements: DataFrame, names: Column) -> DataFrame:
    """A question's own names for its entities: outgoing subjects and incoming values take them."""
    own = F.element_at(names, F.col("source_entity_id"))
    return statements.withColumn("subject_label", F.when(F.col("direction") == "outgoing", F.coalesce(own, "subject_label")).otherwise(F.col("subject_label"))).withColumn(
        "value", F.when(F.col("direction") == "incoming", F.col("value").withField("label", F.coalesce(own, F.col("value.label")))).otherwise(F.col("value")))


def describe_collisions(statements: DataFrame, meta: DataFrame) -> DataFrame:
    """An entity value that reads like its subject gets its description in brackets."""
    d = meta.select(F.col("qid").alias("_q"), F.col("description").alias("_d"))
    same = F.lower(F.trim("value.label")) == F.lower(F.trim("subject_label"))
    j = statements.join(d, (F.col("value.id") == F.col("_q")) & same, "left")
    return j.withColumn("value", F.when(F.col("_d").isNotNull(), F.col("value").withField("label", F.concat("value.label", F.lit(" ("), "_d", F.lit(")")))).otherwise(F.col("value"))).drop("_q", "_d")


def meta_lines(meta: DataFrame) -> DataFrame:
    """(qid, line_pos, line): aliases other than the name, then the description."""
    others = F.slice(F.filter("aliases", lambda a: a != F.col("label")), 1, MOST_ALIASES)
    line = lambda prop, value: F.concat(F.lit("["), "label", F.lit(f"] {prop}: "), value)
    both = F.array(F.when(F.size(others) > 0, line("also known as", F.array_join(others, "; "))), F.when(F.coalesce(F.col("description"), F.lit("")) != "", line("description", F.col("description"))))
    return meta.select("qid", F.posexplode(F.filter(both, lambda x: x.isNotNull())).alias("line_pos", "line")).withColumn("line_pos", F.col("line_pos") - 2)


#: Rows of a key that are dealt out as one.
PACK = 512


def packed(rows: DataFrame, key: str, by: str, name: str, size: int) -> DataFrame:
    """(key, _pack, name): each key's rows in arrays of about `size`, dealt by a hash of `by`, which tells a key's rows apart."""
    packs = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).alias("_packs"))
    dealt = rows.join(packs, key).withColumn("_pack", F.pmod(F.xxhash64(by), "_packs"))
    return dealt.groupBy(key, "_pack").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias(name))


def paired(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str, size: int = PACK) -> DataFrame:
    """The inner join on a key whose rows are many on both sides.

    Packs of rows are joined, and pairs of packs dealt out before they are
    multiplied: the work of one key goes to all tasks, and what is shuffled is
    a side's rows once and a `size`-th of the result.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = packed(left, key, left_by, "_left", size).join(packed(right, key, right_by, "_right", size).withColumnRenamed("_pack", "_other"), key)
    return pairs.repartition(n, key, "_pack", "_other").select(key, "_right", F.inline("_left")).select("*", F.inline("_right")).drop("_right")


def pool(questions: DataFrame, lines: DataFrame, qids: str = "qids") -> DataFrame:
    """Questions fanned out over their keys in order; the first of equal lines of a question stays. lines: qid, line_pos, line.

    A key's equal lines become one before the fan-out. A line that only one key
    has can't come to a question twice then; so only lines of several keys are
    put in order by question, and the others are joined alone.
    """
    keyed = questions.select("question_id", F.posexplode(qids).alias("entity_pos", "qid")).where("qid is not null").groupBy("question_id", "qid").agg(F.min("entity_pos").alias("entity_pos"))
    own = first_of(lines.where("qid is not null"), ["qid", "line"], ["line_pos"])
    same = Window.partitionBy("line")
    told = own.withColumn("_several", F.min("qid").over(same) < F.max("qid").over(same))
    alone, several = (paired(keyed, told.where(c).drop("_several"), "qid", "question_id", "line") for c in (~F.col("_several"), F.col("_several")))
    return alone.unionByName(first_of(several, ["question_id", "line"], ["entity_pos", "line_pos"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, with norms kept off zero."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-10) * (F.sqrt(dot(b, b)) + 1e-10))


def zscores(rows: DataFrame, score: str, question: list[str], group: str) -> DataFrame:
    """Adds z: the score against its group's mean and population deviation; 0 where all are equal.

    Moments are summed before the shuffle and joined back, so a group may be of any size.
    """
    keys = [*question, group]
    moments = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_sd"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    z = F.when(F.col("_sd") > 1e-9, (F.col(score) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    return rows.join(moments, same, "left").withColumn("z", z).drop("_mean", "_sd", *[f"_{k}" for k in keys])


#: Queries and lines of a block: a task multiplies one block of each.
QUERY_BLOCK, LINE_BLOCK = 4096, 65_536


#: More than a matrix product's cosines can differ from sums in order.
ROUNDING = 1e-11


def _rows_and_norms(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, and their norms, kept off zero; squares are added in order."""
    v = vectors.combine_chunks()
    m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
    return m, np.sqrt(np.cumsum(m * m, axis=1)[:, -1]) + 1e-10


def nearest(queries: DataFrame, lines: DataFrame, k: int, query_id: str = "query_id", line_id: str = "line_id", vector: str = "embedding", others: bool = False,
            query_block: int = QUERY_BLOCK, line_block: int = LINE_BLOCK) -> DataFrame:
    """(query_id, line_id, score, rank): the k lines of the greatest cosine for every query, ties by line id.

    Exact: both sides are dealt to blocks by a hash of their ids, and each pair
    of blocks is one matrix product. The lines that it puts among each query's
    best k, or within rounding of them, are scored again by products added in
    order, so that equal vectors have equal scores in any block; k of these
    stay and are merged by query. Scores are rounded to 12 places. others: a
    query isn't its own line.
    Rows without an id or a vector are left out; all vectors have one length.
    """
    side = lambda df, name, n: df.select(F.col(name).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null").withColumn(n, F.xxhash64("id"))
    q, x = side(queries, query_id, "h"), side(lines, line_id, "h")
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_q, n_x = blocks(q, query_block), blocks(x, line_block)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod("h", F.lit(n)).cast("int")  # noqa: E731  the same type as `each`: a cogroup deals int and bigint keys differently
    q = q.select("id", "v", own(n_q).alias("i"), each(n_x).alias("j"))
    x = x.select("id", "v", each(n_q).alias("i"), own(n_x).alias("j"))

    def multiply(qs: pa.Table, xs: pa.Table) -> pa.Table:
        found, ids, (rows, norms), (asked, asked_norms) = [], xs["id"].to_numpy(), _rows_and_norms(xs["v"]), _rows_and_norms(qs["v"])
        units = (rows / norms[:, None]).T
        for a in range(0, len(qs) if len(xs) else 0, 256):
            near = (asked[a : a + 256] / asked_norms[a : a + 256, None]) @ units
            for i, (one, s) in enumerate(zip(qs["id"][a : a + 256].to_pylist(), near, strict=True), a):
                if others:
                    s[ids == one] = -np.inf
                least = np.partition(s, -k)[-k] - ROUNDING if len(s) > k else -np.inf
                best = np.flatnonzero((s >= least) & (s > -np.inf))
                exact = np.round(np.cumsum(rows[best] * asked[i], axis=1)[:, -1] / (asked_norms[i] * norms[best]), 12)
                order = np.lexsort((ids[best], -exact))[:k]
                found.append((np.full(len(order), one), ids[best][order], exact[order]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip((query_id, line_id, "score"), columns, strict=True)))

    some = q.groupBy("i", "j").cogroup(x.groupBy("i", "j")).applyInArrow(multiply, f"`{query_id}` bigint, `{line_id}` bigint, score double")
    return topk(some, "score", [query_id], line_id, k)


def topk(rows: DataFrame, value: str, question: list[str], tie: str, k: int) -> DataFrame:
    """The k best of each question, best first by rank; ties by `tie` ascending. Without a question, of all rows."""
    order = [F.desc(value), tie]
    if question:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*question).orderBy(*order))).where(F.col("rank") <= k)
    # The limit leaves k rows of each task and then of all, so the window has no more than that.
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def floor_topk(rows: DataFrame, value: str, question: list[str], group: str, tie: str, k: int) -> DataFrame:
    """k of each question with floor(k / groups) places for each group first, the rest filled globally; in order of value.

    A group's rows beyond its k best can't be among the question's, so windows
    over groups leave at most k of each to the question's window.
    """
    order, keys = [F.desc(value), tie], question or [F.lit(0).alias("_all")]
    n = rows.groupBy(*question, group).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_groups")).select(*[F.col(c).alias(f"_{c}") for c in question], "_groups")
    best = rows.withColumn("_rg", F.row_number().over(Window.partitionBy(*question, group).orderBy(*order))).where(F.col("_rg") <= k)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in question]) if question else F.lit(True)
    r = best.join(n, same).drop(*[f"_{c}" for c in question]) if question else best.crossJoin(F.broadcast(n))
    first = [(F.col("_rg") <= F.floor(F.lit(k) / F.col("_groups"))).desc(), *order]
    if question:
        r = r.withColumn("_rn", F.row_number().over(Window.partitionBy(*question).orderBy(*first))).where(F.col("_rn") <= k).drop("_rn")
    else:
        r = r.orderBy(*first).limit(k)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(*(question or [F.lit(0)])).orderBy(*order))).drop("_groups", "_rg")


def joined_context(ranked: DataFrame, question: list[str], line: str) -> DataFrame:
    """Each question's lines, best first, parted by blank lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(line).alias("line")))), lambda x: x["line"])
    return ranked.groupBy(*question).agg(F.array_join(ordered, "\n\n").alias("context"), F.count(F.lit(1)).alias("n_lines"))


def hashed_embedding(text: Column | str, dims: int = 64) -> Column:
    """A text's vector without a model: signed counts of its normalised tokens' hashes."""
    t = F.split(normalize(text), " ")
    at = lambda w: F.pmod(F.xxhash64(w), F.lit(dims))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(
        F.filter(t, lambda w: at(w) == i), F.lit(0.0), lambda s, w: s + F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)))
