"""Every registered query of the package proper, bound to the driver tables, and its oracle SQL.

Questions, answers and statements are read off the tables as follows. Scores:
the last event of each (user, type) is the answer of config `type` to question
`user`, its score (event_id mod 100) / 100, its outcome by event_id mod 10.
Statements: an order is a subject, a line of it a binding, the return flag its
property, the ship date its value, the line number a qualifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import statements as S
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import faithfulness as J
from ..operators import retrieval as R
from ..operators import stats as Q
from ..operators.scoring import scored
from . import draws_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# Scores.

SCORES_SQL = """with last as (select user_id, event_type, max(event_id) e from events group by all),
raw as (select user_id question_id, event_type config, e, (e % 100) / 100.0 raw_score,
  case when e % 10 = 0 then 'abstention' when e % 10 = 1 then 'other' when (e % 100) / 100.0 >= 0.5 then 'correct' else 'hallucination' end outcome from last),
scores as (select *, outcome in ('correct', 'hallucination') att, case when outcome in ('correct', 'hallucination') then raw_score else 0.0 end f1,
  case when outcome = 'correct' and raw_score >= 0.9 then 1.0 else 0.0 end em, ['easy', 'middle', 'hard'][1 + question_id % 3] complexity,
  ['entity', 'date', 'boolean', 'numerical'][1 + question_id % 4] answer_type from raw) """


def scores(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").groupBy(F.col("user_id").alias("question_id"), F.col("event_type").alias("config")).agg(F.max("event_id").alias("e"))
    raw = F.col("e") % 100 / 100.0
    out = F.when(F.col("e") % 10 == 0, "abstention").when(F.col("e") % 10 == 1, "other").when(raw >= 0.5, "correct").otherwise("hallucination")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("question_id") % n + 1).cast("int"))
    s = e.withColumn("raw_score", raw).withColumn("outcome", out).withColumn("f1", F.when(T.is_attempted("outcome"), F.col("raw_score")).otherwise(0.0))
    return s.withColumn("em", F.when((F.col("outcome") == "correct") & (F.col("raw_score") >= 0.9), 1.0).otherwise(0.0)).withColumn("score", F.col("f1")).withColumn(
        "complexity", pick(3, "easy", "middle", "hard")).withColumn("answer_type", pick(4, "entity", "date", "boolean", "numerical"))


OUTCOME_SQL = """count(*) n, count(*) filter (att) n_attempted, round(avg((outcome = 'abstention')::int), 6) abstention_rate, round(avg(att::int), 6) coverage,
round(avg((outcome = 'correct')::int), 6) correct_rate, round(avg((outcome = 'hallucination')::int), 6) hallucination_rate, round(avg((outcome = 'other')::int), 6) other_rate,
round(avg(f1), 6) f1, round(avg(em), 6) em, round(coalesce(avg(f1) filter (att), 0.0), 6) f1_attempted,
round(avg((outcome = 'correct')::int) filter (att), 6) correct_rate_attempted"""
OUTCOME_COLUMNS = ["n", "n_attempted", "abstention_rate", "coverage", "correct_rate", "hallucination_rate", "other_rate", "f1", "em", "f1_attempted", "correct_rate_attempted"]


@register(SCORES_SQL + f"select config, {OUTCOME_SQL} from scores group by config")
def outcome_rates(spark, sf):
    return rounded(A.outcomes(scores(spark, sf)).select("config", *OUTCOME_COLUMNS))


@register(SCORES_SQL + f"""select config, case when grouping(complexity) = 0 then 'complexity' when grouping(answer_type) = 0 then 'answer_type' else 'all' end axis,
coalesce(complexity, answer_type) as "value", {OUTCOME_SQL} from scores group by grouping sets ((config), (config, complexity), (config, answer_type))""")
def outcome_by_axis(spark, sf):
    return rounded(A.stratified(scores(spark, sf)).select("config", "axis", "value", *OUTCOME_COLUMNS))


@register(SCORES_SQL + """, v(complexity) as (values ('easy'), ('middle'), ('hard'), ('never'))
select v.complexity, count(question_id) n, count(*) filter (att) n_attempted, round(avg(att::int), 6) coverage from v left join scores using (complexity) group by all""")
def outcome_vocabulary(spark, sf):
    v = spark.createDataFrame([(x,) for x in ("easy", "middle", "hard", "never")], "complexity string")
    return rounded(A.over_vocabulary(scores(spark, sf), v, "complexity").select("complexity", "n", "n_attempted", "coverage"))


@register(SCORES_SQL + """, p as (select a.question_id, a.outcome ao, b.outcome bo, a.f1 af, b.f1 bf from scores a join scores b using (question_id) where a.config = 'click' and b.config = 'view')
select count(*) n, round(avg((ao = 'hallucination')::int) - avg((bo = 'hallucination')::int), 6) delta_hallucination, round(avg((ao = 'correct')::int) - avg((bo = 'correct')::int), 6) delta_correct,
round(avg((ao = 'abstention')::int) - avg((bo = 'abstention')::int), 6) delta_abstention, round(avg(af) - avg(bf), 6) delta_f1 from p""")
def pair_full(spark, sf):
    return rounded(A.pair_full(scores(spark, sf), "click", "view"))


@register(SCORES_SQL + """, p as (select a.outcome = 'hallucination' ha, b.outcome = 'hallucination' hb, a.att and b.att k, a.f1 af, b.f1 bf from scores a join scores b using (question_id) where a.config = 'click' and b.config = 'view')
select count(*) denominator_n, count(*) filter (k) n_common, round(avg(k::int), 6) retained_share, count(*) filter (k and ha and hb) both_hallucinate, count(*) filter (k and ha and not hb) a_only,
count(*) filter (k and not ha and hb) b_only, count(*) filter (k and not ha and not hb) neither, round(avg(ha::int) filter (k) - avg(hb::int) filter (k), 6) delta_hallucination, round(avg(af) filter (k) - avg(bf) filter (k), 6) delta_f1 from p""")
def pair_attempted(spark, sf):
    return rounded(A.pair_attempted(scores(spark, sf), "click", "view"))


@register(SCORES_SQL + """, o(o) as (values ('correct'), ('hallucination'), ('abstention'), ('other')), g as (select x.o b_outcome, y.o a_outcome from o x, o y),
p as (select b.outcome b_outcome, a.outcome a_outcome, count(*) c from scores a join scores b using (question_id) where a.config = 'click' and b.config = 'view' group by all)
select b_outcome, a_outcome, coalesce(c, 0) as "count", round(coalesce(c, 0) / nullif(sum(coalesce(c, 0)) over (partition by b_outcome), 0), 6) "share" from g left join p using (b_outcome, a_outcome)""")
def transition_matrix(spark, sf):
    return rounded(A.transitions(scores(spark, sf), "click", "view"))


@register(SCORES_SQL + """, p as (select question_id, string_agg(config, '+' order by config) filter (att) p from scores group by 1) select coalesce(p, 'none') pattern, count(*) n_questions from p group by 1""")
def attempt_patterns(spark, sf):
    return A.attempt_patterns(scores(spark, sf))


@register(SCORES_SQL + """, f as (select question_id, bool_or(att and config = 'click') a, bool_or(att and config = 'view') b from scores group by 1),
c as (select 'full' cohort, question_id from f union all select 'own_attempted:click', question_id from f where a union all select 'own_attempted:view', question_id from f where b
union all select 'common_attempted:click+view', question_id from f where a and b union all select 'common_attempted:all', question_id from f where a and b)
select cohort, count(distinct question_id) n, sha256(string_agg(question_id::varchar, chr(10) order by question_id::varchar)) members_sha256 from c group by 1""")
def cohort_hashes(spark, sf):
    return A.membership_hash(A.cohorts(scores(spark, sf), configs=("click", "view")), "cohort", "question_id")


@register(SCORES_SQL + "select count(*) n_dropped from (select question_id from scores where config in ('click', 'view') group by 1 having count(*) = 1)")
def n_dropped(spark, sf):
    return A.n_dropped(scores(spark, sf), "click", "view")


@register(SCORES_SQL + "select complexity, count(*) filter (answer_type = 'entity') entity, count(*) filter (answer_type = 'date') date, count(*) filter (answer_type = 'boolean') \"boolean\" from scores group by 1")
def composition_crosstab(spark, sf):
    return A.crosstab(scores(spark, sf), "complexity", "answer_type", ["entity", "date", "boolean"]).select("complexity", "entity", "date", "boolean")


@register(SCORES_SQL + """, th(threshold) as (values (0.3::double), (0.5::double), (0.7::double)), x as (select config, threshold, count(*) n, count(*) filter (raw_score >= threshold) correct, count(*) filter (raw_score < threshold) hallucination
from scores, th where att group by all) select *, row_number() over (partition by threshold order by hallucination / n, config) as "rank" from x""")
def threshold_sweep(spark, sf):
    return Q.threshold_sweep(scores(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@register(SCORES_SQL + """, b as (select question_id, (outcome = 'hallucination')::int h from scores where config = 'view')
select s.config, count(*) n_pairs, count(*) filter ((outcome = 'hallucination')::int < h) n01, count(*) filter ((outcome = 'hallucination')::int > h) n10,
round((count(*) filter ((outcome = 'hallucination')::int > h) - count(*) filter ((outcome = 'hallucination')::int < h)) / count(*), 6) delta from scores s join b using (question_id) where s.config <> 'view' group by 1""")
def mcnemar_counts(spark, sf):
    return rounded(Q.vs_baseline(scores(spark, sf), "view", "hallucination").drop("p_value"))


RECURSIVE_SCORES_SQL = SCORES_SQL.replace("with last", "with recursive last", 1)
INTERVAL_SQL = "n, round(delta, 6) delta, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high, round(p_value, 6) p_value, significant"


@register(RECURSIVE_SCORES_SQL + f""", x as (select 1 g, question_id o, a.f1 - b.f1 v from scores a join scores b using (question_id) where a.config = 'click' and b.config = 'view'),
{draws_sql.paired("x", 1000)} select {INTERVAL_SQL} from intervals""")
def bootstrap_ci(spark, sf):
    """The interval of a difference, whose draws SQL repeats output by output."""
    return rounded(Q.compare_configs(scores(spark, sf), "click", "view", F.col("f1"), resamples=1000))


@register(f"""with recursive x as (select toxic = 1 g, doc_id o, quality::double v from labels), {draws_sql.unpaired("x", 500)}
select n_a, n_b, {INTERVAL_SQL.removeprefix("n, ")} from interval""")
def bootstrap_unpaired(spark, sf):
    return rounded(Q.unpaired_bootstrap(t(spark, sf, "labels").withColumn("g", F.col("toxic") == 1), "quality", "g", "doc_id", resamples=500))


@register()
def bootstrap_poisson(spark, sf):
    return rounded(Q.poisson_bootstrap(Q.deltas(scores(spark, sf), "click", "view", F.col("f1")), "delta", "question_id"))


@register(SCORES_SQL + """, tr as (select question_id from scores where config = 'click' and att), b as (select * from scores where config = 'view')
select (select count(*) from b where question_id in (select * from tr)) n_attempted, (select round(avg(f1), 6) from b where question_id in (select * from tr)) base_on_attempted,
(select count(*) from b where question_id not in (select * from tr)) n_rest, (select round(avg(f1), 6) from b where question_id not in (select * from tr)) base_on_rest""")
def attempted_and_rest(spark, sf):
    return rounded(Q.within_attempted(scores(spark, sf), "click", "view", "f1"))


@register(SCORES_SQL + """, r as (select config, count(*) filter (att and raw_score < 0.3) / count(*) lo, count(*) filter (att and raw_score < 0.7) / count(*) hi from scores group by 1)
select a.config a_config, b.config b_config from r a join r b on a.config < b.config and (a.lo < b.lo) <> (a.hi < b.hi)""")
def rank_swaps(spark, sf):
    r = scores(spark, sf).groupBy("config").agg(*[A.rate(T.is_attempted("outcome") & (F.col("raw_score") < x)).alias(n) for x, n in ((0.3, "lo"), (0.7, "hi"))])
    return A.rank_swaps(r, ("lo", "hi"))


@register(SCORES_SQL + "select string_agg(config, ' < ' order by h, config) ordering from (select config, count(*) filter (outcome = 'hallucination') h from scores group by 1)")
def config_ordering(spark, sf):
    return A.ordering(scores(spark, sf).groupBy("config").agg(F.count_if(F.col("outcome") == "hallucination").alias("h")), "h")


@register(SCORES_SQL + """, g as (select config, complexity, case complexity when 'easy' then 0 when 'middle' then 1 else 2 end o, count(*) n, avg((outcome = 'correct')::int) r from scores group by all having count(*) >= 5)
select config, arg_max(complexity, (r, -o)) highest, arg_min(complexity, (r, o)) lowest from g group by 1""")
def group_extremes(spark, sf):
    g = A.outcomes(scores(spark, sf), ("config", "complexity")).withColumn("o", F.when(F.col("complexity") == "easy", 0).when(F.col("complexity") == "middle", 1).otherwise(2))
    return A.extremes(g, "config", "correct_rate", "complexity", "o", least_n=5)


@register(SCORES_SQL + "select config, abs(avg(f1) - avg(att::int) * coalesce(avg(f1) filter (att), 0)) < 1e-9 holds from scores group by 1")
def f1_identity(spark, sf):
    return A.f1_identity(A.outcomes(scores(spark, sf))).select("config", "holds")


JUDGED_SQL = SCORES_SQL + ", judged as (select *, case when question_id % 5 = 0 then null else (e % 4) / 3.0 end js, ['ok', 'no_context'][1 + (question_id % 5 = 0)::int] status from scores) "


def judged(spark, sf):
    s = scores(spark, sf)
    missing = F.col("question_id") % 5 == 0
    return s.withColumn("score", F.when(~missing, F.col("e") % 4 / 3.0)).withColumn("status", F.when(missing, "no_context").otherwise("ok"))


@register(JUDGED_SQL + """select config, count(*) n_ids, count(*) filter (att) n_attempted, count(*) filter (att and js is not null) n_scoreable, count(*) filter (att and js is null) n_unscored_attempts,
round(avg(js) filter (att), 6) mean, round(avg(js) filter (outcome = 'correct'), 6) mean_correct, round(avg(js) filter (outcome = 'hallucination'), 6) mean_wrong,
round(avg((att and js is not null)::int), 6) share_of_ids, round(avg((js is not null)::int) filter (att), 6) share_of_attempts from judged group by 1""")
def faithfulness_summary(spark, sf):
    return rounded(A.faithfulness_summary(judged(spark, sf)))


@register(JUDGED_SQL + 'select config, status, count(*) as "count" from judged where att and js is null group by all')
def unscored_reasons(spark, sf):
    return A.unscored_reasons(judged(spark, sf))


@register(JUDGED_SQL + """, p as (select a.js a, b.js b from judged a join judged b using (question_id) where a.config = 'click' and b.config = 'view' and a.att and b.att and a.js is not null and b.js is not null)
select count(*) n_common_scoreable, round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, round(avg(a) - avg(b), 6) delta from p""")
def pair_faithfulness(spark, sf):
    return rounded(A.pair_faithfulness(judged(spark, sf), "click", "view"))


@register(JUDGED_SQL + """select config, count(*) filter (js >= 0.5 and outcome = 'correct') grounded_correct, count(*) filter (js >= 0.5 and outcome <> 'correct') grounded_wrong,
count(*) filter (js < 0.5 and outcome = 'correct') ungrounded_correct, count(*) filter (js < 0.5 and outcome <> 'correct') ungrounded_wrong,
round(avg((js < 0.5)::int) filter (outcome <> 'correct'), 6) confabulation_rate from judged where att and js is not null group by 1""")
def grounding_matrix(spark, sf):
    return rounded(A.grounding(judged(spark, sf)))


@register(JUDGED_SQL + """select config, count(*) filter (outcome = 'abstention') abstained, count(*) filter (outcome = 'other') other, count(*) filter (att and js is null) unscored,
count(*) filter (att and js is not null) scoreable, count(*) n, true adds_up from judged group by 1""")
def outcome_accounting(spark, sf):
    return A.accounting(judged(spark, sf))


# Ranking.

COSINE_SQL = """with q as (select embedding::double[] v from embeddings where vec_id = 0),
s as (select vec_id, label, list_dot_product(e.embedding::double[], q.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-10) * (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) + 1e-10)) score from embeddings e, q where vec_id <> 0),
z as (select *, case when stddev_pop(score) over (partition by label) > 1e-9 then (score - avg(score) over (partition by label)) / stddev_pop(score) over (partition by label) else 0 end z from s) """


def similarities(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", "label", R.cosine(F.col("q"), F.col("embedding")).alias("score"))


@register(COSINE_SQL + 'select vec_id, label, round(score, 6) score, row_number() over (order by score desc, vec_id) as "rank" from s qualify "rank" <= 30')
def cosine_topk(spark, sf):
    return rounded(R.topk(similarities(spark, sf), "score", [], "vec_id", 30).withColumn("rank", F.col("rank").cast("bigint")))


@register(COSINE_SQL + 'select vec_id, label, round(score, 6) score, round(z, 6) z, row_number() over (order by z desc, vec_id) as "rank" from z qualify "rank" <= 30')
def zscore_topk(spark, sf):
    z = R.zscores(similarities(spark, sf), "score", [], "label")
    return rounded(R.topk(z, "z", [], "vec_id", 30).withColumn("rank", F.col("rank").cast("bigint")))


@register(COSINE_SQL + """, r as (select *, row_number() over (partition by label order by z desc, vec_id) rg, (select count(distinct label) from z) g from z),
c as (select *, row_number() over (order by (rg <= 30 // g) desc, z desc, vec_id) rn from r)
select vec_id, label, round(score, 6) score, round(z, 6) z, row_number() over (order by z desc, vec_id) as "rank" from c where rn <= 30""")
def floor_topk(spark, sf):
    z = R.zscores(similarities(spark, sf), "score", [], "label")
    return rounded(R.floor_topk(z, "z", [], "label", "vec_id", 30).withColumn("rank", F.col("rank").cast("bigint")))


@register("""with e as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-10 n from embeddings),
p as (select a.vec_id, b.vec_id neighbour, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (a.n * b.n), 12) score from e a join e b on a.vec_id <> b.vec_id)
select vec_id, neighbour, round(score, 6) score, row_number() over (partition by vec_id order by score desc, neighbour) as "rank" from p qualify "rank" <= 5""")
def embedding_neighbours(spark, sf):
    """The five nearest others of every vector, by products of blocks."""
    e = t(spark, sf, "embeddings")
    q, x = e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "line_id")
    near = R.nearest(q, x, 5, others=True).select(F.col("query_id").alias("vec_id"), F.col("line_id").alias("neighbour"), "score", F.col("rank").cast("bigint").alias("rank"))
    return rounded(near)


# Texts.

WORDS_SQL = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '')"
NORM_SQL = "list_filter(string_split_regex(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x not in ('', 'a', 'an', 'the'))"


@register(f"""with d as (select doc_id, {WORDS_SQL} w from documents), i as (select doc_id, w, unnest(generate_series(0, greatest(0, (ceil((len(w) - 300) / 250.0) * 250)::bigint), 250)) s from d where len(w) > 0)
select doc_id source_entity_id, (s // 250)::int as "index", count(*) over (partition by doc_id)::int n_chunks, md5(array_to_string(w[s + 1:s + 300], ' ')) text_md5 from i""")
def chunk_windows(spark, sf):
    return R.chunks(t(spark, sf, "documents"), "doc_id", "text").select("source_entity_id", "index", "n_chunks", F.md5("text").alias("text_md5"))


@register(f"select doc_id, md5(array_to_string({NORM_SQL.format('text')}, ' ')) normal_md5, len({WORDS_SQL})::int n_words from documents")
def normalize_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(T.normalize("text")).alias("normal_md5"), T.word_count("text").alias("n_words"))


ITEMS_SQL = "i as (select *, row_number() over (order by item_id) - 1 r from benchmark), d as (select *, doc_id % (select count(*) from benchmark) r from documents)"


def paired_items(spark, sf) -> DataFrame:
    """Every document beside one benchmark item; all items have their turn, by rank."""
    b = t(spark, sf, "benchmark")
    items = b.select("item_id", F.col("text").alias("item"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id")) - 1).alias("r"))  # one small table
    d = t(spark, sf, "documents").crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("n"))))
    return d.withColumn("_r", F.pmod("doc_id", F.col("n"))).join(items, F.col("_r") == F.col("r")).select("doc_id", "text", "item_id", "item")


@register(f"""with {ITEMS_SQL}, p as (select doc_id, item_id, {NORM_SQL.format('d.text')} p, {NORM_SQL.format('i.text')} g from d join i using (r)),
x as (select doc_id, w, count(*) c from (select doc_id, unnest(p) w from p) group by all), y as (select doc_id, w, count(*) c from (select doc_id, unnest(g) w from p) group by all),
s as (select doc_id, sum(least(x.c, y.c)) n from x join y using (doc_id, w) group by 1)
select doc_id, item_id, round(case when coalesce(n, 0) = 0 then 0 else 2.0 * n / (len(p) + len(g)) end, 6) f1, (p = g)::int::double em from p left join s using (doc_id)""")
def token_f1(spark, sf):
    j = paired_items(spark, sf)
    return rounded(j.select("doc_id", "item_id", T.token_f1("text", "item").alias("f1"), T.exact_match("text", "item").alias("em")))


@register(f"""with {ITEMS_SQL}, p as (select doc_id, item_id, d.text h, case when doc_id % 2 = 0 then i.text else string_split(d.text, chr(10))[-1] end g from d join i using (r)),
n as (select doc_id, item_id, {NORM_SQL.format('h')} h, {NORM_SQL.format('g')} g from p)
select doc_id, item_id, len(g) > 0 and contains(' ' || array_to_string(h, ' ') || ' ', ' ' || array_to_string(g, ' ') || ' ') found from n""")
def contains_span(spark, sf):
    """Whole texts looked through for an item, or for their own last line."""
    needle = F.when(F.col("doc_id") % 2 == 0, F.col("item")).otherwise(F.element_at(F.split("text", "\n"), -1))
    return paired_items(spark, sf).select("doc_id", "item_id", T.contains_span("text", needle).alias("found"))


REFUSAL_SQL = "|".join(p.replace("{g}", r"(?:\w+\s+){0,2}").replace("'", "''") for p in T.REFUSALS)


@register(f"""with a as (select conv_id, turn, case turn % 4 when 0 then 'The context does not mention it. ' when 1 then 'Yes, ' when 2 then 'It cannot be said. ' else '' end || text t from conversations where role = 'assistant')
select conv_id, turn, regexp_matches(t, '(?i){REFUSAL_SQL}') refuses, regexp_matches(substr(t, 1, 90), '(?i){REFUSAL_SQL}') in_head,
regexp_matches(substr(t, 1, 90), '(?i){REFUSAL_SQL}') and length(regexp_replace(substr(t, 1, 90), '(?is)({REFUSAL_SQL}).*$', '')) <= 30 opens from a""")
def refusal_flags(spark, sf):
    lead = F.when(F.col("turn") % 4 == 0, "The context does not mention it. ").when(F.col("turn") % 4 == 1, "Yes, ").when(F.col("turn") % 4 == 2, "It cannot be said. ").otherwise("")
    c = t(spark, sf, "conversations").where("role = 'assistant'").withColumn("t", F.concat(lead, "text"))
    return c.select("conv_id", "turn", T.is_abstention("t").alias("refuses"), T.refuses_in_head("t").alias("in_head"), T.opens_with_refusal("t").alias("opens"))


@register(f"""with a as (select conv_id, turn, {NORM_SQL.format("(case turn % 3 when 0 then 'Yes, ' when 1 then 'No. ' else '' end || text)")} k from conversations)
select conv_id, turn, case when k[1] in ('yes', 'true', 'correct', 'right', 'affirmative') then true when k[1] in ('no', 'not', 'false', 'incorrect', 'wrong', 'negative') then false
when list_has_any(k, ['yes', 'true', 'correct', 'right', 'affirmative']) then true when list_has_any(k, ['no', 'not', 'false', 'incorrect', 'wrong', 'negative']) then false end asserted from a""")
def boolean_parse(spark, sf):
    lead = F.when(F.col("turn") % 3 == 0, "Yes, ").when(F.col("turn") % 3 == 1, "No. ").otherwise("")
    return t(spark, sf, "conversations").select("conv_id", "turn", T.boolean_of(F.concat(lead, "text")).alias("asserted"))


@register(r"select o_orderkey, list_sort(list_distinct(list_transform(regexp_extract_all('on ' || strftime(o_orderdate, '%Y-%m-%d') || ' for ' || (o_custkey % 3000)::varchar || ' units', '\b(1\d{3}|20\d{2})\b', 1), lambda x: x::int))) as years from orders")
def year_extract(spark, sf):
    s = F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" for "), (F.col("o_custkey") % 3000).cast("string"), F.lit(" units"))
    return t(spark, sf, "orders").select("o_orderkey", F.array_sort(T.years(s)).alias("years"))


@register("""select o_orderkey, (case when o_orderkey % 3 = 0 then 1.0 when o_orderkey % 3 = 1 then case when day(o_orderdate) = 1 then 1.0 else 0.0 end else 1.0 end)::double matched from orders""")
def date_match(spark, sf):
    """The order date against itself in prose, against the first of its month in prose, and against its year."""
    prose = F.date_format("o_orderdate", "MMMM d, yyyy")
    first = F.date_format(F.trunc("o_orderdate", "month"), "d MMMM yyyy")
    pred = F.when(F.col("o_orderkey") % 3 == 0, prose).when(F.col("o_orderkey") % 3 == 1, first).otherwise(F.date_format("o_orderdate", "'in' yyyy"))
    return t(spark, sf, "orders").select("o_orderkey", T.date_match(pred, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("matched"))


@register("""select l_orderkey, l_linenumber, (case l_linenumber % 3 when 0 then l_quantity when 1 then l_quantity * 1000 else l_quantity * 1000000 + 300000 end)::double quantity from lineitem""")
def number_phrases(spark, sf):
    """Quantities written as phrases and read again."""
    n = F.col("l_quantity").cast("int").cast("string")
    phrase = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("about "), n, F.lit(" items"))).when(F.col("l_linenumber") % 3 == 1, F.concat(n, F.lit(" thousand"))).otherwise(F.concat(n, F.lit(" million 300 thousand people")))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.get(N.numbers(phrase), F.lit(0)).alias("quantity"))


@register("""select event_id, ['entity', 'numerical', 'boolean', 'date'][1 + event_id % 4] answer_type, case when event_id % 4 = 2 and event_id % 3 = 0 then 'hallucination' else 'correct' end outcome, 0.0::double em,
(case event_id % 4 when 0 then 0.5 when 2 then case when event_id % 3 = 0 then 0.0 else 1.0 end else 1.0 end)::double f1, (case when event_id % 4 = 2 and event_id % 3 = 0 then 0.0 else 1.0 end)::double score from events""")
def scored_answers(spark, sf):
    """Answers of every type through the whole dispatcher."""
    e = t(spark, sf, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("entity", "numerical", "boolean", "date")]), (F.col("event_id") % 4 + 1).cast("int"))
    v = F.round("value").cast("int").cast("string")
    answer = F.when(kind == "numerical", F.concat(F.lit("It is "), v)).when(kind == "boolean", F.lit("Yes, it is")).when(kind == "date", F.date_format("ts", "MMMM d, yyyy")).otherwise(F.concat(F.lit("The answer is "), "event_type"))
    gold = F.when(kind == "numerical", v).when(kind == "boolean", F.when(F.col("event_id") % 3 == 0, "No").otherwise("Yes")).when(kind == "date", F.date_format("ts", "yyyy-MM-dd")).otherwise(F.col("event_type"))
    rows = e.select("event_id", answer.alias("answer"), F.array(gold).alias("forms"), F.array().cast("array<string>").alias("members"), F.array().cast("array<string>").alias("question_entities"), kind.alias("answer_type"), F.lit("stop").alias("finish_reason"))
    return rounded(scored(rows).select("event_id", "answer_type", "outcome", "em", "f1", "score"))


@register("select md5(text) text_md5, min(doc_id) doc_id, count(*) n from documents group by 1")
def exact_dup_groups(spark, sf):
    return t(spark, sf, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@register("select doc_id, source from documents qualify row_number() over (partition by text order by doc_id) = 1")
def dedupe_first(spark, sf):
    return R.first_of(t(spark, sf, "documents"), ["text"], ["doc_id"]).select("doc_id", "source")


@register("select lang, count(*) n, round(avg(n_chars), 1) mean, quantile_cont(n_chars, 0.5) median, min(n_chars) least, max(n_chars) most from documents group by 1")
def context_stats(spark, sf):
    return A.context_sizes(t(spark, sf, "documents"), "lang", "n_chars")


@register("select lang, list_sort(list(n_chars))[1 + count(*) // 2] upper_median from documents group by 1")
def upper_median(spark, sf):
    return A.exact_median(t(spark, sf, "documents"), ["lang"], "n_chars", "upper_median", upper=True)


@register("select o_orderpriority, quantile_cont(o_totalprice, 0.5) median, list_sort(list(o_totalprice))[1 + count(*) // 2] upper_median from orders group by 1")
def price_medians(spark, sf):
    """Medians of values that are all different."""
    o, by = t(spark, sf, "orders"), "o_orderpriority"
    upper = A.exact_median(o, [by], "o_totalprice", "upper_median", upper=True).withColumnRenamed(by, "_by")
    return A.exact_median(o, [by], "o_totalprice").join(upper, F.col(by) == F.col("_by")).drop("_by")


@register("select source, count(*) n, round(count(*) / sum(count(*)) over (), 6) \"share\" from documents group by 1")
def composition_shares(spark, sf):
    return rounded(A.composition(t(spark, sf, "documents"), "source"))


@register("select case when n_chars < 0 then 0 when n_chars >= 10000 then 21 else floor(n_chars / 500.0) + 1 end::bigint bin, count(*) n from documents group by 1")
def length_histogram(spark, sf):
    return A.histogram(t(spark, sf, "documents"), "n_chars", 0, 10_000, 20)


# Statements.

FOLD_SQL = """with f as (select l_orderkey || '-' || l_returnflag st, l_orderkey, l_returnflag, min(l_shipdate) d, list_sort(list(lpad(l_linenumber::varchar, 2, '0'))) q from lineitem group by all) """


def statements(spark, sf):
    li = t(spark, sf, "lineitem")
    null = F.lit(None).cast("string")
    value = lambda label, kind: F.struct(F.lit("value").alias("snaktype"), F.lit(kind).alias("datatype"), null.alias("id"), label.alias("label"), null.alias("raw"), null.alias("unit"), F.lit(9).alias("precision"))
    day = F.min("l_shipdate").over(Window.partitionBy("l_orderkey", "l_returnflag"))
    line = F.lpad(F.col("l_linenumber").cast("string"), 2, "0")
    return R.fold_statements(li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_returnflag").alias("statement_id"), F.col("l_orderkey").cast("string").alias("subject_id"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("subject_label"), F.col("l_returnflag").alias("property_id"),
        F.concat(F.lit("flag "), "l_returnflag").alias("property_label"), value(F.date_format(day, "yyyy-MM-dd"), "Time").alias("value"), F.lit("normal").alias("rank"),
        F.lit("outgoing").alias("direction"), F.col("l_orderkey").cast("string").alias("source_entity_id"),
        F.struct(F.lit("L").alias("property_id"), F.lit("line").alias("property_label"), value(line, "Quantity").alias("value")).alias("qualifier")))


@register(FOLD_SQL + "select st statement_id, len(q)::int n_qualifiers, strftime(d, '%Y-%m-%d') label from f")
def statement_fold(spark, sf):
    return statements(spark, sf).select("statement_id", F.size("qualifiers").alias("n_qualifiers"), F.col("value.label").alias("label"))


@register(FOLD_SQL + "select st statement_id, '[order ' || l_orderkey || '] flag ' || l_returnflag || ': ' || year(d) || ' (' || array_to_string(list_transform(q, lambda x: 'line: ' || x), '; ') || ')' line from f")
def render_statement(spark, sf):
    return statements(spark, sf).select("statement_id", S.render_statement(F.col("subject_label"), F.col("property_label"), F.col("value"), F.col("qualifiers")).alias("line"))


@register("""select p_partkey, contains(lower(p_name || ' ' || p_type), 'commons') or starts_with(lower(p_type), 'category') or p_size % 7 = 0 or (p_size % 7 = 1 and ends_with(lower(p_brand) || ' id', ' id')) noise from part""")
def noise_filter(spark, sf):
    kind = F.when(F.col("p_size") % 7 == 0, "ExternalId").when(F.col("p_size") % 7 == 1, "String").otherwise("WikibaseItem")
    label = F.when(F.col("p_size") % 7 == 1, F.concat("p_brand", F.lit(" ID"))).otherwise(F.col("p_type"))
    return t(spark, sf, "part").select("p_partkey", S.is_noise(label, kind).alias("noise"))


@register("select l_orderkey, l_linenumber, l_suppkey from lineitem qualify row_number() over (partition by l_suppkey, l_returnflag order by l_orderkey, l_linenumber) <= 30")
def cap_per_property(spark, sf):
    return R.cap(t(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber"], 30).select("l_orderkey", "l_linenumber", "l_suppkey")


@register("select distinct l_suppkey::varchar k, 'P' || (l_partkey % 50) property_id from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)")
def reverse_discovery(spark, sf):
    st = t(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("value_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("property_id"))
    return R.reverse_properties(st, t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("k")), "k")


@register("""with d as (select distinct l_suppkey value_id, l_returnflag property_id, l_orderkey statement_id from lineitem)
select *, row_number() over (partition by value_id, property_id order by statement_id)::int rn, count(*) over (partition by value_id, property_id) >= 30 truncated from d qualify rn <= 30""")
def reverse_capped(spark, sf):
    return R.reverse_capped(t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("value_id"), F.col("l_returnflag").alias("property_id"), F.col("l_orderkey").alias("statement_id")))


@register("select n_nationkey qid, n_name \"label\", array_to_string(list_sort(list_distinct(list(s_name))), ';') aliases from nation left join supplier on s_nationkey = n_nationkey group by all")
def entity_meta(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    m = R.entity_meta(n.select(F.col("n_nationkey").alias("qid"), F.col("n_name").alias("label"), F.lit(None).cast("string").alias("description"), F.col("s_name").alias("alias"), F.lit(None).cast("int").alias("redirect")))
    return m.select("qid", "label", F.array_join("aliases", ";").alias("aliases"))


@register("select s_suppkey, coalesce(case when n_regionkey < 3 then 'our ' || n_name end, n_name) shown from supplier join nation on s_nationkey = n_nationkey")
def label_override(spark, sf):
    """Suppliers as statements about their nation, whose name a question may give."""
    n = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    st = n.select("s_suppkey", "n_name", "n_regionkey", F.col("n_nationkey").cast("string").alias("source_entity_id"), F.lit("outgoing").alias("direction"), F.col("n_name").alias("subject_label"), F.struct(F.col("s_name").alias("label")).alias("value"))
    names = F.when(F.col("n_regionkey") < 3, F.create_map("source_entity_id", F.concat(F.lit("our "), "n_name"))).otherwise(F.create_map().cast("map<string,string>"))
    return R.override_labels(st, names).select("s_suppkey", F.col("subject_label").alias("shown"))


@register("select c_custkey question_id, line from (select c_custkey, n_name || ' ' || s_name line, row_number() over (partition by c_custkey, n_name || ' ' || s_name order by s_suppkey) r from customer join supplier on s_nationkey = c_nationkey join nation on n_nationkey = s_nationkey) where r = 1")
def evidence_pool(spark, sf):
    """Customers as questions about their nation, suppliers as its lines."""
    q = t(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), F.array(F.col("c_nationkey").cast("string")).alias("qids"))
    lines = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").cast("string").alias("qid"), F.col("s_suppkey").alias("line_pos"), F.concat("n_name", F.lit(" "), "s_name").alias("line"))
    return R.pool(q, lines).select("question_id", "line")


# Sampling, sets, sources.

@register("""with n as (select lang, count(*) n, row_number() over (order by count(*) desc, lang) r, count(*) over () k from documents group by 1),
d as (select *, row_number() over (partition by lang order by md5(doc_id || ':42'), doc_id) rn from documents) select doc_id, lang from d join n using (lang) where rn <= 101 // k + (r <= 101 % k)::int""")
def stratified_sample(spark, sf):
    return Q.stratified_sample(t(spark, sf, "documents"), "lang", "doc_id", 101).select("doc_id", "lang")


@register("select doc_id, source, row_number() over (partition by source order by md5(doc_id || ':0'), doc_id)::int turn from documents order by turn, source limit 50")
def round_robin(spark, sf):
    return Q.round_robin(t(spark, sf, "documents"), "source", "doc_id", 50).select("doc_id", "source", "turn")


@register("select event_id, (props::json->>'$.k')::bigint k from events")
def json_props(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@register("""select 'semi' kind, count(*) n from documents where exists (select 1 from labels l where l.doc_id = documents.doc_id) union all select 'anti', count(*) from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id)
union all select 'outer', count(*) from documents d full outer join labels l using (doc_id) where d.text is null or l.toxic is null""")
def semi_anti_outer(spark, sf):
    d, lab = t(spark, sf, "documents"), t(spark, sf, "labels")
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(d.join(lab, "doc_id", "left_semi"), "semi").unionByName(n(d.join(lab, "doc_id", "left_anti"), "anti")).unionByName(n(d.join(lab, "doc_id", "full_outer").where("text is null or toxic is null"), "outer"))


@register("select doc_id, (2 + doc_id % 2)::int n_claims, (1 + doc_id % 2)::int n_supported, case when doc_id % 3 = 0 then 'unparsed_verdicts' else 'ok' end status, case when doc_id % 3 <> 0 then round((1 + doc_id % 2) / (2.0 + doc_id % 2), 6) end score from labels")
def faithfulness_scores(spark, sf):
    """Judge texts built from labels and parsed again: one claim unsupported, and unread in a third of the rows."""
    more = F.col("doc_id") % 2 == 1
    last = F.when(F.col("doc_id") % 3 == 0, "").otherwise("\n1. UNSUPPORTED")
    rows = t(spark, sf, "labels").select(
        "doc_id", F.lit("an answer").alias("answer"), F.lit("a context").alias("context"), F.when(more, "- one\n- **two**\n* three").otherwise("1. one\n2) two").alias("raw_claims"),
        F.concat(F.when(more, "2. SUPPORTED\n3. supported").otherwise("2. SUPPORTED"), last).alias("raw_verdicts"), F.lit(None).cast("string").alias("raw_repair"))
    return rounded(J.scored(rows).select("doc_id", "n_claims", "n_supported", "status", "score"))


@register()
def rag_pipeline(spark, sf):
    """Retrieval over all suppliers of each nation, ranked, rendered and answered by the offline model."""
    from .pipelines import rag_answers

    n = t(spark, sf, "nation")
    q = n.select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("Which supplier is of "), "n_name", F.lit("?")).alias("question"), F.array(F.col("n_nationkey").cast("string")).alias("qids"), F.array("n_name").alias("entity_names"))
    lines = t(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("qid"), F.col("s_suppkey").alias("line_pos"), F.concat(F.lit("["), "s_name", F.lit("] balance: "), F.col("s_acctbal").cast("string")).alias("line"))
    return rag_answers(q, lines, k=10, facts=True).select("question_id", "answer", F.size("top_lines").alias("n_lines"))
