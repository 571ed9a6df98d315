"""Proportional stratified interleaving: every shard gets each source's share of the rows.

Rows are shuffled by a seeded hash within their source and get a fractional rank (rank + start) / size
there, `start` being a seeded number in [0, 1) for each source, so that many tiny sources spread out
too. Sorted by fractional rank, the rows are cut into shards of equal counts (at most one row apart).

No source is ever sorted in one task: ranks are a count of the rows in lower hash blocks, from a
small table of block counts, plus a rank inside the block. The final order is cut up the same way.
Blocks are 256 at least and grow with the table, so that none passes about `ROWS_A_BLOCK` rows; their number
does not change any row's place.
Only keys and hashes are shuffled, never texts.

Defined cases: null sources form a source of their own; null texts have size 1 and the checksum of the
empty text; repeated rows each get a place of their own; an empty table gives no rows; extra columns
are ignored. Null doc_ids hash like any value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ROWS_A_BLOCK, LEAST_BITS = 1_000_000, 8


def _placed(df: DataFrame, group: list[str], block: str, order: list[str], out: str) -> DataFrame:
    """Adds the 0-based position of each row of a group in (block, order), block counts being summed apart."""
    before = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    starts = (
        df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(before.orderBy(block).rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_size", F.sum("_n").over(before))
    )
    inside = df.withColumn("_at", F.row_number().over(W.partitionBy(*group, block).orderBy(*order)) - 1)
    keys = [*group, block]
    joined = inside.alias("a").join(starts.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return joined.select("a.*", (F.col("_at") + F.coalesce("_before", F.lit(0))).alias(out), F.col("_size").alias(f"{out}_of")).drop("_at")


def stratified_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, strata: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, stratum, position, shard, slot) for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    bits = max(LEAST_BITS, (docs.count() // ROWS_A_BLOCK).bit_length())
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(strata).cast("string").alias("stratum"),
    ).withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "stratum"))
    rows = rows.withColumn("_block", F.shiftrightunsigned("_hash", 64 - bits).cast("int"))
    ranked = _placed(rows, ["stratum"], "_block", ["_hash", "doc_id", "text_crc32"], "_rank")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "stratum"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ranked = ranked.withColumn("_frac", (F.col("_rank") + start) / F.col("_rank_of"))
    ranked = ranked.withColumn("_slice", F.floor(F.col("_frac") * (1 << bits + 4)).cast("int"))
    whole = _placed(ranked, [], "_slice", ["_frac", "stratum", "_hash", "doc_id", "text_crc32"], "position")
    shard = F.expr(f"position * {n_shards} div position_of")
    first = F.expr(f"(shard * position_of + {n_shards - 1}) div {n_shards}")
    return (
        whole.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("position") - first).cast("long"))
        .select("doc_id", "size", "text_crc32", "stratum", "position", "shard", "slot")
    )
