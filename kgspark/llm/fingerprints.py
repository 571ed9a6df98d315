"""Threshold-scaled sketches of word shingles, as DataFrame expressions alone.

A sketch keeps every shingle hash (48 bits of xxhash64 over five word hashes) below `fraction` of the
hash range. So sketches of any two texts compare on the same part of the hash space: the overlap
estimates their Jaccard likeness and the containment of a short text in a very long one, and the union
of two sketches, cut at the same threshold, is the sketch of the texts' shingle union.

Defined cases: null texts are empty; a text of one to four words is one shingle; a text without words
has the empty sketch; a text with words of which no hash is low enough keeps its least hash, so that
short texts still compare. Two empty sketches have likeness 1, an empty and another 0. Equal texts have
equal sketches. Repeated doc_ids are ordered by text; null doc_ids come last. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import partitions, range_bounds, range_bucket, words_col

SHINGLE, FRACTION = 5, 0.25


def with_sketch(df: DataFrame, text: str, out: str, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Adds `out`, the sorted array<long> sketch of the column `text`."""
    limit = int(fraction * (1 << 48))
    hashed = df.withColumn("_w", F.transform(words_col(F.col(text)), lambda w: F.xxhash64(w)))
    last = F.size("_w") - (size - 1)
    part = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(size)])
    whole = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last - 1), part)).when(F.size("_w") > 0, F.array(part(F.lit(0))))
    hashed = hashed.withColumn("_s", F.transform(F.coalesce(whole, F.array().cast("array<long>")), lambda h: F.shiftrightunsigned(h, 16)))
    low = F.array_sort(F.array_distinct(F.filter("_s", lambda h: h < F.lit(limit))))
    hashed = hashed.withColumn(out, low)
    kept = F.when((F.size(out) == 0) & (F.size("_s") > 0), F.array(F.array_min("_s"))).otherwise(F.col(out))
    return hashed.withColumn(out, kept).drop("_w", "_s")


def likeness(a: str, b: str) -> Column:
    """Jaccard estimate of two sketches, 0 to 1."""
    shared, both = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / (both - shared)).cast("double")


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def merged(a: str, b: str, fraction: float = FRACTION) -> Column:
    """The sketch of the union of two texts' shingles: hashes below the threshold, or else the least one."""
    every = F.array_sort(F.array_union(a, b))
    low = F.filter(every, lambda h: h < F.lit(int(fraction * (1 << 48))))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(every, 1, 1))


def printed(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def _dealt(docs: DataFrame) -> DataFrame | None:
    """Rows (doc_id, _text, _b, _copy) dealt to ranges _b of doc_id; None for an empty table.

    The highest row of each range is also copied (_copy = 1) into the range above it, and the highest of
    all into the lowest range: there it follows the range's last row in descending doc_id. So that each range
    finds its rows' successors alone, without a sort of the whole table.
    """
    bounds = range_bounds(docs, "doc_id", partitions(docs.sparkSession))
    at = range_bucket(F.col("doc_id"), bounds).cast("int")
    tops = {r.b: r.top for r in docs.groupBy(at.alias("b")).agg(F.max("doc_id").alias("top")).collect()}  # one row a range
    if not tops:
        return None
    kept = sorted(tops)
    above = {b: kept[(i + 1) % len(kept)] for i, b in enumerate(kept)}
    literal = lambda of, kind: F.array(*[F.lit(of.get(b)).cast(kind) for b in range(len(bounds) + 1)])
    own = docs.select("doc_id", "_text", at.alias("_at"))
    copied = F.when(F.col("doc_id").eqNullSafe(F.get(literal(tops, "long"), F.col("_at"))), F.get(literal(above, "int"), F.col("_at")))
    places = F.array_compact(F.array(F.struct(F.col("_at").alias("b"), F.lit(0).alias("copy")), F.when(copied.isNotNull(), F.struct(copied.alias("b"), F.lit(1).alias("copy")))))
    return own.withColumn("_to", F.explode(places)).select("doc_id", "_text", F.col("_to.b").alias("_b"), F.col("_to.copy").alias("_copy")).repartition(len(kept), "_b")


def edited_fingerprints(docs: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Sketches of each text and of its edited text, and their likeness to each other and to the next document's.

    Edited: the last floor(n/3) code points give way to the first as many of the next document.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = _dealt(base)
    if rows is None:
        rows = base.select("*", F.lit(0).alias("_b"), F.lit(0).alias("_copy"))
    order = W.partitionBy("_b").orderBy("_copy", F.col("doc_id").desc_nulls_last(), "_text")
    own = with_sketch(rows, "_text", "_sketch", size, fraction)
    own = own.withColumn("_next", F.lead("_text").over(order)).withColumn("_next_sketch", F.lead("_sketch").over(order)).where("_copy = 0")
    n = F.char_length("_text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut))
    both = with_sketch(own.withColumn("_edited", edited), "_edited", "_edited_sketch", size, fraction)
    return both.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        printed("_sketch").alias("fingerprint"), printed("_edited_sketch").alias("edited_fingerprint"),
        likeness("_sketch", "_edited_sketch").alias("near_edited"), likeness("_sketch", "_next_sketch").alias("near_next"),
    )
