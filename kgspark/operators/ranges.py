"""Running sums and ranks within groups of any size: rows are cut into ranges of the order, and only ranges have tasks of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.store import stored


def ranged(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows, written once with `_part`, the range of (keys, order) that they are in.

    There are about as many rows in each of the `parts` ranges (default: the session's shuffle partitions), so a group of many rows has several. Rows that are equal in keys and order are in one.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def part_sums(cut: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(_k, _part, _s, _before): the sum of value in each range of a group `_k`, a struct of its keys (nulls are a group), and in the ranges before. A group has a row for each of its ranges."""
    sums = cut.groupBy(F.struct(*keys).alias("_k"), "_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_s"))
    prior = W.partitionBy("_k").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_s").over(prior), F.lit(0)))


def running(cut: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Rows of `ranged` with `out`: the sum of value over the rows before in their group; keys are those of `ranged` or more. Rows of equal order count in any order."""
    at = F.struct(F.struct(*keys).alias("_k"), "_part")
    inside = W.partitionBy("_at").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    offsets = part_sums(cut, keys, value).where("_before <> 0").select(F.struct("_k", "_part").alias("_at"), "_before")
    got = cut.withColumn("_at", at).withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, "_at", "left")
    return got.select(*cut.columns, (F.col("_in") + F.coalesce("_before", F.lit(0))).alias(out))


def at_rank(cut: DataFrame, key: str, value: str, weight: str, rank: Column) -> DataFrame:
    """(key, value): the value of each group at a rank counted from 1, where each row of `ranged` (by key and value) stands for `weight` equal ones.

    rank is an expression of `_n`, the group's weight. Sums by range tell which one holds it, and only that range's rows are looked at.
    """
    spots = part_sums(cut, [key], F.col(weight)).withColumn("_n", F.sum("_s").over(W.partitionBy("_k"))).withColumn("_rank", rank)
    spots = spots.where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_s")))
    held = cut.withColumn("_k", F.struct(key)).join(spots, ["_k", "_part"])
    upto = F.col("_before") + F.sum(weight).over(W.partitionBy("_k").orderBy(value))
    return held.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col(weight) < F.col("_rank"))).select(key, F.col(value).alias("value"))
