"""Groups of any size are counted by ranges: no key needs one task, and rows equal a plain window's."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.operators import evidence as E
from kgspark.operators import ranges as N
from kgspark.operators import retrieval as R


def test_a_hot_question_is_spread_and_counted_rightly(spark):
    hot = spark.range(6000).select(F.col("id").alias("report_id"), F.lit("w").alias("ws"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("q"), (F.col("id") % 30).cast("string"))).alias("question"),
                                   F.when(F.col("id") % 3 > 0, F.concat(F.lit("u"), (F.col("id") % 3).cast("string"))).alias("user"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("created_at"))
    reports = hot.unionByName(spark.createDataFrame([(9001, None, None, None, None), (9002, None, None, "u", 3), (9003, None, None, None, 4)], "report_id long, ws string, question string, user string, created_at long"))
    got = {r.report_id: r.version for r in E.report_versions(reports, parts=8).collect()}
    same = W.partitionBy("ws", "question", "user").orderBy("created_at", "report_id").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("ws", "question").orderBy("created_at", "report_id").rowsBetween(W.unboundedPreceding, -1)
    nobody = F.coalesce(F.count_if(F.col("user").isNull()).over(before), F.lit(0))
    plain = reports.select("report_id", (1 + F.when(F.col("user").isNull(), nobody).otherwise(F.count(F.lit(1)).over(same) + nobody)).alias("v"))
    assert got == {r.report_id: r.v for r in plain.collect()} and len(got) == 6003
    cut = N.ranged(reports, ["ws", "question"], ["created_at", "report_id"], 8)
    sizes = [r["count"] for r in cut.where("question = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2000


def test_ranks_of_a_hot_group_by_ranges(spark):
    v = spark.range(5000).select(F.when(F.col("id") % 5 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 35).cast("string"))).alias("g"), F.pmod(F.xxhash64("id"), F.lit(3000)).cast("double").alias("v"))
    v = v.unionByName(spark.createDataFrame([(None, 7.0), (None, 1.0), ("none", None)], "g string, v double"))
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.value for r in R.nearest_rank(v, "g", "v", p, parts=8).collect()}
        want = {}
        for r in v.where("v is not null").collect():
            want.setdefault(r.g, []).append(r.v)
        assert got == {g: sorted(x)[round(p * (len(x) - 1))] for g, x in want.items()}
    assert R.nearest_rank(v.where("false"), "g", "v", 0.5).count() == 0


def test_blocks_of_questions_and_strings_come_one_at_a_time(spark):
    v = spark.range(60).select(F.col("id"), F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)).cast("float") for i in range(4)]).alias("embedding"))
    q = v.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    rows = lambda d: sorted((r.qid, r.rank, r.id) for r in d.collect())
    assert rows(R.vector_topk(q, v, 3, block_bytes=100)) == rows(R.vector_topk(q, v, 3)) and R.vector_topk(q, v, 3, block_bytes=100).count() == 36
    texts = spark.createDataFrame([(i, f"Some w{i % 7} and W{i % 5}x end") for i in range(40)] + [(99, None)], "text_id long, text string")
    wants = spark.createDataFrame([(i, f"w{i}") for i in range(8)] + [(8, "W3"), (9, ""), (10, None)], "item_id long, text string")
    want = {(r.item_id, t.text_id) for r in wants.collect() for t in texts.collect() if r.text and r.text.lower() in (t.text or "").lower()}
    for size in (4, 4 << 20):
        got = [tuple(r) for r in R.expected_hits(texts, wants, block_bytes=size).collect()]
        assert set(got) == want and len(got) == len(want)


def test_tables_go_when_the_result_is_written(spark, tmp_path):
    import os

    from kgspark.store import stored, tables_until_written

    with tables_until_written() as tables:
        one = stored(spark.range(5))
        stored(one.where("id > 1")).write.parquet(f"file://{tmp_path}/out")
    paths = [t.stored_at.removeprefix("file://") for t in tables]
    assert len(paths) == 2 and not any(map(os.path.exists, paths)) and spark.read.parquet(f"file://{tmp_path}/out").count() == 3
    kept = stored(spark.range(2))
    assert len(tables) == 2 and kept.count() == 2
