"""Pattern matching over edges: equi-joins on (workspace, node), bounded paths, shared neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.store import stored, unsent

MOST_SENT = 100_000  # names that a join may broadcast


def match_edges(edges: DataFrame, rels: list[str], src_label: str | None = None, tgt_label: str | None = None) -> DataFrame:
    """One hop of typed edges: (ws, src, rel, tgt)."""
    got = edges.where(F.col("rel").isin(rels))
    if src_label:
        got = got.where(F.col("src_label") == src_label)
    if tgt_label:
        got = got.where(F.col("tgt_label") == tgt_label)
    return got.select("ws", "src", "rel", "tgt")


def optional_match(nodes: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    """Every node with its targets over one relation, or a null one."""
    hop = edges.where(F.col("rel") == rel).select("ws", F.col("src_label").alias("label"), F.col("src").alias("name"), F.col("tgt").alias("neighbor"))
    return nodes.select("ws", "label", "name").join(hop, ["ws", "label", "name"], "left")


def two_hop(edges: DataFrame, rel: str, via: str = "src") -> DataFrame:
    """Unordered pairs (a < c) that share the node at the `via` end of two edges of one relation, with how many they share."""
    end = "tgt" if via == "src" else "src"
    one = edges.where(F.col("rel") == rel).select("ws", F.col(via).alias("mid"), F.col(end).alias("n")).distinct()
    pairs = one.withColumnRenamed("n", "a").join(one.withColumnRenamed("n", "c"), ["ws", "mid"]).where("a < c")
    return pairs.groupBy("ws", "a", "c").agg(F.count(F.lit(1)).alias("shared"))


def open_triangles(edges: DataFrame, rel: str) -> DataFrame:
    """Pairs of sources that share a co-source but no target of their own: (ws, a, c)."""
    direct = two_hop(edges, rel, via="tgt").select("ws", "a", "c")
    sym = direct.unionByName(direct.select("ws", F.col("c").alias("a"), F.col("a").alias("c")))
    far = sym.select("ws", F.col("c").alias("mid"), "a").join(sym.select("ws", F.col("a").alias("mid"), "c"), ["ws", "mid"]).where("a < c")
    return far.select("ws", "a", "c").distinct().join(direct, ["ws", "a", "c"], "left_anti")


def legs_of(edges: DataFrame, rels: list[str], directed: bool = True) -> DataFrame:
    """(ws, start_label, start, end_label, end, id): edges of the relations, each from both ends unless directed."""
    e = edges.where(F.col("rel").isin(rels)).select("ws", "src_label", "src", "tgt_label", "tgt", F.xxhash64("ws", "rel", "src_label", "src", "tgt_label", "tgt").alias("id"))
    if not directed:
        e = e.unionByName(e.select("ws", F.col("tgt_label").alias("src_label"), F.col("tgt").alias("src"), F.col("src_label").alias("tgt_label"), F.col("src").alias("tgt"), "id"))
    return e.select("ws", F.col("src_label").alias("start_label"), F.col("src").alias("start"), F.col("tgt_label").alias("end_label"), F.col("tgt").alias("end"), "id")


def paths(edges: DataFrame, rels: list[str], max_hops: int, directed: bool = True, start_label: str | None = None, end_label: str | None = None) -> DataFrame:
    """Trails of 1 to max_hops edges, no edge twice, from and to nodes of the given labels: (ws, start, end, hops).

    A trail of k edges is two halves that meet in the middle and share no edge. Only halves, of (max_hops + 1) / 2 edges at most, carry their edges; those of one length are written once and
    serve all trails that they are part of.
    """
    e = legs_of(edges, rels, directed)
    one = stored(e.select("ws", "start_label", "start", "end_label", "end", F.array("id").alias("used")), "trails")
    halves = {1: one}

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        after = right.select("ws", F.col("start").alias("end"), F.col("end_label").alias("_label"), F.col("end").alias("_to"), F.col("used").alias("_more"))
        both = left.join(after, ["ws", "end"]).where(~F.arrays_overlap("used", "_more"))
        return both.select("ws", "start_label", "start", F.col("_label").alias("end_label"), F.col("_to").alias("end"), F.concat("used", "_more").alias("used"))

    for k in range(2, (max_hops + 1) // 2 + 1):
        halves[k] = stored(joined(halves[k - 1], one), "trails")
    out = None
    for k in range(1, max_hops + 1):
        first, second = halves[(k + 1) // 2], halves.get(k // 2)
        first = first.where(F.col("start_label") == start_label) if start_label else first
        if second is not None:
            second = second.where(F.col("end_label") == end_label) if end_label else second
            got = joined(first, second)
        else:
            got = first.where(F.col("end_label") == end_label) if end_label else first
        got = got.select("ws", "start", "end", F.lit(k).cast("long").alias("hops"))
        out = got if out is None else out.unionByName(got)
    return out


def disputed_targets(edges: DataFrame, src_label: str | None = None) -> DataFrame:
    """Nodes with an incoming SUPPORTS and an incoming CONTRADICTS edge."""
    into = lambda rel: edges.where(F.col("rel") == rel).select("ws", F.col("tgt").alias("name"))
    return into("SUPPORTS").distinct().join(into("CONTRADICTS"), ["ws", "name"], "left_semi")


def entity_context(edges: DataFrame, names: DataFrame, limit: int = 25) -> DataFrame:
    """For each (ws, name), ignoring case: distinct (neighbor, rel), the degree before the limit, found or not. Edges (or claims) may repeat; names are written once, as they are read three times."""
    from kgspark.operators.graph import both_ways

    asked = stored(names.select("ws", F.col("name").alias("asked"), F.lower("name").alias("_k")), "context-names")
    near = both_ways(edges).withColumn("_k", F.lower("a")).join(F.broadcast(asked) if asked.count() <= 100_000 else asked, ["ws", "_k"])
    near = stored(near.select("ws", "asked", F.col("b").alias("neighbor"), "rel").distinct(), "context")
    degree = near.groupBy("ws", "asked").agg(F.count(F.lit(1)).alias("degree"))
    first = near.withColumn("_n", F.row_number().over(W.partitionBy("ws", "asked").orderBy("neighbor", "rel"))).where(F.col("_n") <= limit).drop("_n")  # cut in each task before the shuffle
    got = asked.select("ws", "asked").join(degree, ["ws", "asked"], "left").join(first, ["ws", "asked"], "left")
    return got.select("ws", F.col("asked").alias("name"), "neighbor", "rel", F.coalesce("degree", F.lit(0)).alias("degree"), F.col("degree").isNotNull().alias("found"))


def connections(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (ws, a, b): whether an edge joins them, and their shared neighbours, sorted and comma-joined. Edges (or claims) may repeat.

    Only edges at asked names are joined: they and the pairs are written once, and of the edges at `a` only those are followed whose other end is next to some `b`. None of these tables is broadcast, as they are small as files and not in the driver, but names of up to MOST_SENT.
    """
    from kgspark.operators.graph import both_ways

    pairs = stored(pairs.select("ws", "a", "b"), "connection-pairs")
    names = stored(pairs.select("ws", F.explode(F.array("a", "b")).alias("a")).distinct(), "connection-names")
    legs = stored(both_ways(edges).select("ws", "a", "b").join(F.broadcast(names) if names.count() <= MOST_SENT else unsent(names), ["ws", "a"], "left_semi").distinct(), "connection-legs")
    last = stored(legs.join(unsent(pairs.select("ws", F.col("b").alias("a")).distinct()), ["ws", "a"], "left_semi").select("ws", F.col("b").alias("mid"), F.col("a").alias("b")), "connection-ends")
    first = legs.withColumnRenamed("b", "mid").join(unsent(last.select("ws", "mid").distinct()), ["ws", "mid"], "left_semi")
    direct = legs.join(unsent(pairs.distinct()), ["ws", "a", "b"], "left_semi").withColumn("direct", F.lit(True))
    near = pairs.distinct().join(unsent(first), ["ws", "a"]).join(unsent(last), ["ws", "mid", "b"]).where("mid <> a and mid <> b")
    near = near.groupBy("ws", "a", "b").agg(F.array_sort(F.collect_set("mid")).alias("mids")).select("ws", "a", "b", F.array_join("mids", ",").alias("shared"), F.size("mids").cast("long").alias("n_shared"))
    return pairs.join(unsent(direct), ["ws", "a", "b"], "left").join(unsent(near), ["ws", "a", "b"], "left").select("ws", "a", "b", F.coalesce("direct", F.lit(False)).alias("direct"), F.coalesce("shared", F.lit("")).alias("shared"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def detect_conflicts(claims: DataFrame) -> DataFrame:
    """Disputed pairs (ws, src, tgt): supported and contradicted by different documents, with how many pairs of claims.

    Counted without making pairs: all supporting times all contradicting claims, less those of the same document.
    """
    one = lambda rel: F.count_if(F.col("rel") == rel)
    per = claims.where(F.col("rel").isin("SUPPORTS", "CONTRADICTS") & F.col("doc").isNotNull()).groupBy("ws", "src", "tgt", "doc").agg(one("SUPPORTS").alias("s"), one("CONTRADICTS").alias("c"))
    got = per.groupBy("ws", "src", "tgt").agg((F.sum("s") * F.sum("c") - F.sum(F.col("s") * F.col("c"))).alias("matches"))
    return got.where("matches > 0")


def flag_conflicts(edges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Edges with conflict_flag: support or contradiction edges of a disputed pair."""
    keys = conflicts.select("ws", "src", "tgt", F.lit(True).alias("_c")).distinct()
    return edges.join(keys, ["ws", "src", "tgt"], "left").withColumn("conflict_flag", F.coalesce("_c", F.lit(False)) & F.col("rel").isin("SUPPORTS", "CONTRADICTS")).drop("_c")


def flag_new_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs that new claims put in dispute, against old and new claims."""
    every = old.unionByName(new)
    touched = new.where(F.col("rel").isin("SUPPORTS", "CONTRADICTS")).select("ws", "src", "tgt").distinct()
    return detect_conflicts(every.join(touched, ["ws", "src", "tgt"], "left_semi"))


def conflict_edges(claims: DataFrame) -> DataFrame:
    """(ws, src, tgt, claim_types, documents): disputed pairs as directed CONFLICTS_WITH edges, with sorted, comma-joined claim types and documents."""
    keys = detect_conflicts(claims).select("ws", "src", "tgt")
    got = claims.where(F.col("rel").isin("SUPPORTS", "CONTRADICTS")).join(keys, ["ws", "src", "tgt"], "left_semi")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return got.groupBy("ws", "src", "tgt").agg(joined("rel").alias("claim_types"), joined("doc").alias("documents"))


def list_conflicts(claims: DataFrame, entities: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Conflicts (ws, source, target, claim_types, documents): all as directed, or those that touch entities (ws, name; any case), seen from the entity; at most `limit` a workspace or entity."""
    found = conflict_edges(claims).withColumnRenamed("src", "source").withColumnRenamed("tgt", "target")
    if entities is None:
        got, group = found, ["ws"]
    else:
        back = found.select("ws", F.col("target").alias("source"), F.col("source").alias("target"), "claim_types", "documents")
        asked = entities.select("ws", F.lower("name").alias("_k")).distinct()
        got, group = found.unionByName(back).distinct().withColumn("_k", F.lower("source")).join(asked, ["ws", "_k"]), ["ws", "_k"]
    if limit:
        got = got.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy("source", "target"))).where(F.col("_n") <= limit)
    return got.select("ws", "source", "target", "claim_types", "documents")


def conflicts_for(edges: DataFrame, names: DataFrame, most_names: int = 20, most_rows: int = 25) -> DataFrame:
    """(qid, ws, source, target, claim_types, documents): flagged edges that leave the first names (qid, ws, name, place) of each question, once for each unordered pair.

    Of a question's pairs, in order of (source, target), `most_rows` count, and the first of two that are one pair stays.
    """
    asked = names.where(F.col("place") <= most_names).select("qid", "ws", F.col("name").alias("src")).distinct()
    flagged = edges.where(F.col("conflict_flag") & F.col("rel").isin("SUPPORTS", "CONTRADICTS"))
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    got = flagged.join(asked, ["ws", "src"]).groupBy("qid", "ws", F.col("src").alias("source"), F.col("tgt").alias("target")).agg(sets("rel").alias("claim_types"), sets("doc").alias("documents"))
    got = got.withColumn("_n", F.row_number().over(W.partitionBy("qid", "ws").orderBy("source", "target"))).where(F.col("_n") <= most_rows)
    pair = W.partitionBy("qid", "ws", F.least("source", "target"), F.greatest("source", "target")).orderBy("_n")
    return got.withColumn("_m", F.row_number().over(pair)).where("_m = 1").drop("_n", "_m")
