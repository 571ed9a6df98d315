"""Driver queries of vector search and entity resolution over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import resolution as E
from kgspark.operators import retrieval as R
from kgspark.operators import vindex as X
from kgspark.plans.registry import over_tables
from kgspark.store import stored

LOW, HIGH = 0.25, 0.35
_COSINE = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-10)"


def named(e: DataFrame) -> DataFrame:
    return e.select(F.col("vec_id").alias("seq"), F.col("label").alias("kind"), "embedding")


@over_tables(
    "vec_2_topk",
    "embeddings",
    f"""with q as (select vec_id as qid, embedding::double[] as v from embeddings where vec_id % 50 = 0),
    c as (select vec_id as id, embedding::double[] as e from embeddings),
    s as (select qid, id, 1 - {_COSINE.format(a='v', b='e')} as d from q, c)
    select qid, id, round(d, 6) as distance, row_number() over (partition by qid order by round(d, 12), id)::bigint as rank from s qualify rank <= 8""",
)
def vec_2(e: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows."""
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return R.vector_topk(queries, e.select(F.col("vec_id").alias("id"), "embedding"), 8).select("qid", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def asked(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row whose id is divisible by 50, and all rows."""
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), "embedding")


@over_tables("vec_2_index", "embeddings")
def vec_2_index(e: DataFrame) -> DataFrame:
    """The same questions by the inverted-file index."""
    queries, rows = asked(e)
    found = X.search_index(e.sparkSession, X.build_index(rows), queries, 8)
    return found.select("qid", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@over_tables(
    "vec_2_index_recall",
    "embeddings",
    f"""with q as (select vec_id as qid, embedding::double[] as v from embeddings where vec_id % 50 = 0),
    s as (select qid, vec_id as id, 1 - {_COSINE.format(a='v', b='embedding::double[]')} as d from q, embeddings qualify row_number() over (partition by qid order by round(1 - {_COSINE.format(a='v', b='embedding::double[]')}, 12), vec_id) <= 8)
    select qid, count(*)::bigint as neighbours, true as reached from s group by qid""",
)
def vec_2_index_recall(e: DataFrame) -> DataFrame:
    """Each question's exact neighbours, and whether nine of ten of all questions' are found by the index."""
    queries, rows = asked(e)
    exact = stored(R.vector_topk(queries, rows, 8).select("qid", "id"), "exact")
    got = X.recall_at(X.search_index(e.sparkSession, X.build_index(rows), queries, 8), exact).first()
    return exact.groupBy("qid").agg(F.count(F.lit(1)).alias("neighbours"), F.lit(bool(got.recall >= 0.9)).alias("reached"))


@over_tables(
    "vec_5_bands",
    "embeddings",
    f"""with n as (select vec_id as seq, label, embedding::double[] as e from embeddings),
    s as (select a.seq, b.seq as other, {_COSINE.format(a='a.e', b='b.e')} as sim from n a join n b on a.label = b.label and b.seq < a.seq)
    select seq, arg_max(other, {{'s': sim, 'o': -other}}) as best, round(max(sim), 6) as sim, case when max(sim) >= {HIGH} then 'merge' when max(sim) < {LOW} then 'new' else 'borderline' end as band from s group by seq""",
)
def vec_5_bands(e: DataFrame) -> DataFrame:
    return E.best_earlier(named(e), LOW, HIGH).withColumn("sim", F.round("sim", 6))


def _loop(low: float, high: float, accepts: str) -> str:
    """The sequential loop in SQL: each kind's names in order, with the list of leaders so far."""
    return f"""with recursive n as (select label as kind, vec_id as seq, embedding::double[] as e, row_number() over (partition by label order by vec_id) as i from embeddings),
    r as (
        select kind, i, seq, [{{'s': seq, 'e': e}}] as leaders, seq as leader, 'new' as decision from n where i = 1
        union all
        select kind, i, seq, case when leader = seq then list_append(leaders, {{'s': seq, 'e': e}}) else leaders end, leader, decision from (
            select *, case when sim >= {high} or (sim >= {low} and {accepts}) then other else seq end as leader,
                   case when sim >= {high} then 'auto_merge' when sim < {low} then 'new' when {accepts} then 'adjudicated_merge' else 'adjudicated_new' end as decision
            from (select kind, i, seq, e, leaders, best.v as sim, -best.o as other from (
                    select n.kind, n.i, n.seq, n.e, r.leaders, list_sort(list_transform(r.leaders, lambda x: {{'v': {_COSINE.format(a='x.e', b='n.e')}, 'o': -x.s}}), 'desc')[1] as best
                    from r join n on n.kind = r.kind and n.i = r.i + 1))))
    select seq, leader, decision from r"""


@over_tables("vec_4_resolved", "embeddings", _loop(HIGH, HIGH, "false").replace("select seq, leader, decision from r", "select seq, leader from r"))
def vec_4(e: DataFrame) -> DataFrame:
    return E.resolve(named(e), HIGH)


@over_tables("vec_5_resolved", "embeddings", _loop(LOW, HIGH, "(seq + other) % 2 = 0"))
def vec_5(e: DataFrame) -> DataFrame:
    """Three bands, with an adjudicator that takes two names for one if their numbers' sum is even."""
    return E.resolve_banded(named(e), LOW, HIGH, lambda pairs: pairs.withColumn("same", (F.col("seq") + F.col("other")) % 2 == 0))


@over_tables(
    "vec_6_decided_pairs",
    "embeddings",
    f"""with p as (select a.vec_id as pair_id, {_COSINE.format(a='a.embedding::double[]', b='b.embedding::double[]')} as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select pair_id, round(sim, 6) as sim, case when sim >= {HIGH} then 'merge' when sim < 0.0 then 'new' else 'borderline' end as band,
           sim >= {HIGH} or (sim >= 0.0 and pair_id % 3 = 0) as same from p""",
)
def vec_6(e: DataFrame) -> DataFrame:
    """Each vector against the next one."""
    pairs = e.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("pair_id"), F.col("embedding").alias("b")), "pair_id")
    return E.decide_pairs(pairs, 0.0, HIGH, lambda p: p.withColumn("same", F.col("pair_id") % 3 == 0)).withColumn("sim", F.round("sim", 6))
