"""Graph building and upkeep: nodes and edges are aggregations of claims, so replay is idempotent and removal exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.store import stored

EDGE = ["ws", "src_label", "src", "rel", "tgt_label", "tgt"]
NODE = ["ws", "label", "name"]


def ends(claims: DataFrame) -> DataFrame:
    """(ws, label, name, source_id): both ends of every claim."""
    two = F.array(F.struct(F.col("src_label").alias("label"), F.col("src").alias("name")), F.struct(F.col("tgt_label").alias("label"), F.col("tgt").alias("name")))
    return claims.select("ws", "source_id", F.explode(two).alias("e")).select("ws", "e.label", "e.name", "source_id")


def build_nodes(claims: DataFrame) -> DataFrame:
    """One row for each (ws, label, name), with the sorted set of its sources; null sources add nothing."""
    return nodes_of(ends(claims))


def nodes_of(named: DataFrame) -> DataFrame:
    """Nodes of ends (ws, label, name, source_id)."""
    got = named.groupBy(*NODE).agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return got.withColumn("source_count", F.size("source_ids").cast("long"))


def build_edges(claims: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row for each edge key: the first writer's document and confidence, all sources. With nodes, edges lacking an end are dropped."""
    first = F.min(F.struct("seq", (-F.col("confidence")).alias("down"), "doc")).alias("f")
    got = claims.groupBy(*EDGE).agg(first, F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    got = got.select(*EDGE, F.col("f.doc").alias("doc"), (-F.col("f.down")).alias("confidence"), "source_ids", F.size("source_ids").cast("long").alias("source_count"))
    return got if nodes is None else with_ends(got, nodes)


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    columns = edges.columns
    for side in ("src", "tgt"):
        keys = nodes.select("ws", F.col("label").alias(f"{side}_label"), F.col("name").alias(side))
        edges = edges.join(keys, ["ws", f"{side}_label", side], "left_semi")
    return edges.select(*columns)


def node_keys(edges: DataFrame) -> DataFrame:
    """Each node (ws, label, name) that edges name, once."""
    two = F.array(F.struct(F.col("src_label").alias("label"), F.col("src").alias("name")), F.struct(F.col("tgt_label").alias("label"), F.col("tgt").alias("name")))
    return edges.select("ws", F.explode(two).alias("e")).select("ws", "e.label", "e.name").distinct()


def edge_keys(claims: DataFrame) -> DataFrame:
    """Each edge once, by its key alone: for what needs neither documents nor sources."""
    return claims.select(*EDGE).distinct()


def merge_claims(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new claims, each once."""
    return old.unionByName(new).dropDuplicates()


def upsert_last(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Last writer wins: the value of the highest order for each key."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def upsert_first(rows: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """First writer wins: the values of the lowest order for each key (ties: the least values); later ones change nothing."""
    got = rows.groupBy(*key).agg(F.min(F.struct(order, *values)).alias("_f"))
    return got.select(*key, *[F.col(f"_f.{v}").alias(v) for v in values])


def remove_source(claims: DataFrame, ws: str, source_id: str) -> DataFrame:
    """Claims without one source of one workspace; rebuilding from them removes exactly its contribution."""
    return claims.where(~((F.col("ws") == ws) & F.col("source_id").eqNullSafe(F.lit(source_id))))


def removal_counts(claims: DataFrame, ws: str, source_id: str) -> DataFrame:
    """Nodes and edges that lose their last source, of those of one workspace."""
    own = claims.where(F.col("ws") == ws)
    gone = F.when(F.count_if(~F.col("source_id").eqNullSafe(F.lit(source_id))) == 0, 1).otherwise(0).alias("gone")
    nodes = ends(own).groupBy(*NODE).agg(gone).agg(F.sum("gone").alias("nodes_removed"))
    return nodes.crossJoin(own.groupBy(*EDGE).agg(gone).agg(F.sum("gone").alias("edges_removed")))  # two single rows


def delete_documents(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims of neither the documents (ws, doc) nor edges at their papers."""
    docs = documents.select("ws", "doc").distinct()
    left = claims.join(docs, ["ws", "doc"], "left_anti")
    for side in ("src", "tgt"):
        left = left.join(docs.select("ws", F.col("doc").alias(side), F.lit("Paper").alias(f"{side}_label")), ["ws", side, f"{side}_label"], "left_anti")
    return left.select(*claims.columns)


def untagged_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a source that no edge touches."""
    used = edges.select("ws", F.col("src_label").alias("label"), F.col("src").alias("name")).unionByName(edges.select("ws", F.col("tgt_label").alias("label"), F.col("tgt").alias("name")))
    return nodes.where("source_count = 0").join(used, NODE, "left_anti")


def weight_of(confidence: Column) -> Column:
    """A missing or zero confidence weighs 1."""
    return F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(1.0))


def weighted_edges(edges: DataFrame) -> DataFrame:
    """(ws, s, t, w): parallel edges summed by name; blanks and self-loops dropped; a missing or zero confidence weighs 1."""
    w = weight_of(F.col("confidence"))
    named = edges.where("trim(src) <> '' and trim(tgt) <> '' and src <> tgt")
    return named.groupBy("ws", F.col("src").alias("s"), F.col("tgt").alias("t")).agg(F.sum(w).alias("w"))


def node_types(nodes: DataFrame) -> DataFrame:
    """One label for each name: the least."""
    return nodes.groupBy("ws", "name").agg(F.min("label").alias("label"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: (ws, a, b, rel)."""
    two = F.array(F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")), F.struct(F.col("tgt").alias("a"), F.col("src").alias("b")))
    return edges.select("ws", "rel", F.explode(two).alias("e")).select("ws", "e.a", "e.b", "rel")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("ws", F.col("a").alias("name")).agg(F.count(F.lit(1)).alias("degree"))


def in_degrees(edges: DataFrame, rel: str) -> DataFrame:
    return edges.where(F.col("rel") == rel).groupBy("ws", F.col("tgt").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def out_degrees(edges: DataFrame, rel: str, label: str) -> DataFrame:
    return edges.where((F.col("rel") == rel) & (F.col("src_label") == label)).groupBy("ws", F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def top_per_workspace(rows: DataFrame, score: str, k: int) -> DataFrame:
    """The k highest rows of each workspace, ties by name."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("ws").orderBy(F.col(score).desc(), "name")))
    return ranked.where(F.col("rank") <= k)


def hub_view(edges: DataFrame, limit: int = 150, most_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each workspace's hub view: the top hubs, the edges that touch them, degrees inside that subset, the top `limit` nodes, and the edges between those.

    most_edges, if given, bounds a workspace's touching edges, in order of their ends. The edges are written once without their other columns, as four jobs read them.
    """
    keys = stored(edges.select(*EDGE), "hub-edges")
    hubs = top_per_workspace(degrees(keys), "degree", max(15, limit // 6)).select("ws", F.col("name").alias("h"))
    hubs = F.broadcast(hubs) if hubs.count() <= 100_000 else hubs
    at = lambda side: F.col("h").alias(side)
    touched = keys.join(hubs.select("ws", at("src")), ["ws", "src"], "left_semi").unionByName(keys.join(hubs.select("ws", at("tgt")), ["ws", "tgt"], "left_semi").join(hubs.select("ws", at("src")), ["ws", "src"], "left_anti"))
    if most_edges:
        touched = touched.withColumn("_n", F.row_number().over(W.partitionBy("ws").orderBy("src", "rel", "tgt", "src_label", "tgt_label"))).where(F.col("_n") <= most_edges).drop("_n")
    touched = stored(touched, "hub-touched")
    nodes = top_per_workspace(degrees(touched), "degree", limit)
    kept = nodes.select("ws", "name")
    inside = touched.join(kept.withColumnRenamed("name", "src"), ["ws", "src"], "left_semi").join(kept.withColumnRenamed("name", "tgt"), ["ws", "tgt"], "left_semi")
    return nodes, inside


def in_workspace(rows: DataFrame, ws: str) -> DataFrame:
    """Rows of one workspace; over a table partitioned by ws only its folder is read."""
    return rows.where(F.col("ws") == ws)


def without_workspace(rows: DataFrame, ws: str) -> DataFrame:
    """Rows of all other workspaces, of any table."""
    return rows.where(~F.col("ws").eqNullSafe(F.lit(ws)))


def union_rows(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, equal ones once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables below path, partitioned by workspace."""
    nodes.write.partitionBy("ws").mode("overwrite").parquet(f"{path}/nodes")
    edges.write.partitionBy("ws").mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
