"""Graph analytics as distributed jobs over weighted edges (ws, s, t, w): rank, structure, missing links, shortest paths.

Iterative jobs write each round to the shared folder, so that lineage stays short and a lost executor costs a round at most; rounds that are used up are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.operators import blocks
from kgspark.operators.blocks import Blocks, contracted, merged, moves, tied
from kgspark.store import forget, stored, unsent
from kgspark.vocab import CONFIDENCE_ELSE, CONFIDENCES, PREDICTED, PREDICTED_ELSE


#: Sentences that stand in for what a phrasing model left out, and that tell why a gap is notable.
CONJECTURE = "CONJECTURE: %s may have an untested %s relationship with %s."
CAVEAT = "This is a structural conjecture only; the direct relationship is not present in the graph."
NOTABLE, ACROSS = "%d shared intermediaries with no direct graph edge", " across detected communities."


def pagerank(w: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, iterations: int | None = None) -> DataFrame:
    """(ws, name, score): weighted PageRank of every workspace at once; dangling mass spreads evenly; stops at an L1 change under N * tol.

    Nodes are numbered once; rounds then move numbers alone. The edges stay dealt by their source, so a round shuffles only the contributions, summed before they move.
    """
    spark = w.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    names = stored(w.select("ws", F.explode(F.array("s", "t")).alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()), "rank-names")
    at = lambda c, i: unsent(names.select("ws", F.col("name").alias(c), F.col("id").alias(i)))
    total = w.groupBy("ws", "s").agg(F.sum("w").alias("all"))
    edges = w.join(unsent(total), ["ws", "s"]).join(at("s", "src"), ["ws", "s"]).join(at("t", "dst"), ["ws", "t"])
    edges = stored(edges.select("src", "dst", (F.col("w") / F.col("all")).alias("p")), "rank-edges")
    n = names.groupBy("ws").agg(F.count(F.lit(1)).cast("double").alias("n"))
    base = names.select("id", "ws").join(n, "ws").join(unsent(edges.select(F.col("src").alias("id"), F.lit(1).alias("out")).distinct()), "id", "left")
    base = stored(base.select("id", "ws", "n", F.col("out").isNull().alias("dangling")), "rank-base")
    dealt = edges.repartition(parts, "src").persist()
    ranks = stored(base.withColumn("score", 1 / F.col("n")), "rank-0")
    for _ in range(iterations or max_iter):
        sent = unsent(ranks.select(F.col("id").alias("src"), "score")).join(dealt, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        lost = ranks.groupBy("ws").agg(F.sum(F.when(F.col("dangling"), F.col("score")).otherwise(0.0)).alias("lost"))  # a row a workspace
        score = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - alpha) / F.col("n")
        new = stored(ranks.drop("old").withColumnRenamed("score", "old").join(unsent(sent), "id", "left").join(lost, "ws").select("id", "ws", "n", "dangling", "old", score.alias("score")), "rank")
        forget(ranks)
        ranks = new
        if iterations is None and new.groupBy("ws").agg((F.sum(F.abs(F.col("score") - F.col("old"))) >= F.max("n") * tol).alias("on")).where("on").limit(1).count() == 0:
            break
    dealt.unpersist()
    forget(edges, base)
    return unsent(ranks.select("id", "score")).join(names, "id").select("ws", "name", "score")


def influence_for(ranks: DataFrame, names: DataFrame) -> DataFrame:
    """The ranks of asked names (ws, name), with each one's place in its workspace (by score, then name): the number of nodes before it.

    No workspace is sorted in one task: nodes are counted by steps of the score, steps are summed up, and only within an asked node's own step is it compared.
    """
    step = F.floor(F.log2(F.greatest("score", F.lit(1e-300))) * 64).cast("int")
    rows = ranks.withColumn("_step", step)
    counts = rows.groupBy("ws", "_step").agg(F.count(F.lit(1)).alias("_n"))
    above = counts.withColumn("_above", F.coalesce(F.sum("_n").over(W.partitionBy("ws").orderBy(F.col("_step").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a few thousand steps a workspace
    asked = rows.join(names.select("ws", "name").distinct(), ["ws", "name"], "left_semi")
    wanted = asked.select("ws", "_step").distinct()
    inside = rows.join(wanted, ["ws", "_step"], "left_semi").withColumn("_at", F.row_number().over(W.partitionBy("ws", "_step").orderBy(F.col("score").desc(), "name")))
    placed = inside.join(names.select("ws", "name").distinct(), ["ws", "name"], "left_semi").join(above.select("ws", "_step", "_above"), ["ws", "_step"])
    return placed.select("ws", "name", "score", (F.col("_above") + F.col("_at")).cast("long").alias("place"))


def undirected(w: DataFrame) -> DataFrame:
    """(ws, a, b, w), a < b: weights of both directions summed."""
    return w.where("s <> t").groupBy("ws", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.sum("w").alias("w"))


def _neighbours(w: DataFrame) -> DataFrame:
    u = undirected(w)
    return u.select("ws", "a", "b", "w").unionByName(u.select("ws", F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity(w: DataFrame, labels: DataFrame) -> DataFrame:
    """(ws, q): weighted modularity of a labelling (ws, name, label). Labels are joined to each pair of neighbours once; all sums come from the written weights between labels."""
    at = lambda c, n: labels.select("ws", F.col("name").alias(c), F.struct("label").alias(n))
    pairs = undirected(w).join(at("a", "la"), ["ws", "a"], "left").join(at("b", "lb"), ["ws", "b"], "left")
    tied = stored(pairs.groupBy("ws", "la", "lb").agg(F.sum("w").alias("w")), "label-weights")
    both = F.col("la").isNotNull() & F.col("lb").isNotNull()
    inside = F.sum(F.when(F.col("la.label") == F.col("lb.label"), 2 * F.col("w")).otherwise(0.0))
    sums = tied.groupBy("ws").agg((2 * F.sum("w")).alias("m2"), inside.alias("inside"), F.max(both).alias("known")).where("known")
    ends = tied.select("ws", F.explode(F.array("la", "lb")).alias("l"), "w").where("l is not null")
    degree = ends.groupBy("ws", "l").agg(F.sum("w").alias("d")).groupBy("ws").agg(F.sum(F.col("d") * F.col("d")).alias("d2"))
    return sums.join(degree, "ws").select("ws", (F.col("inside") / F.col("m2") - F.col("d2") / (F.col("m2") * F.col("m2"))).alias("q"))


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the least node that each node of edges (a, b) reaches, by rounds of least neighbours with shortcuts over what tasks have left of the edges; each round is a written table. Nodes are numbers."""
    edges = stored(contracted(edges), "connected-few")
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "connected-edges")
    forget(edges)
    roots = stored(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("root")), "connected")
    while True:
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = roots.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        far = roots.select(F.col("id").alias("root"), F.col("root").alias("far"))
        last, roots = roots, stored(step.join(far, "root", "left").select("id", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "connected")
        forget(last)
        if roots.where("root <> old").limit(1).count() == 0:
            forget(both)
            return roots.select("id", "root")


def _settled(graph: DataFrame, held: Blocks, start: DataFrame, level: int, rounds: int | None, tol: float, patience: int) -> DataFrame:
    """(id, ws, k, m2, label): nodes of graph (ws, a, b, w), held in blocks, moved from the labels start (id, label) until none moves, or `patience` rounds in turn don't raise the modularity, summed over workspaces, by more than tol.

    A round has two halves, of a split of the nodes by a hash that is another in each round, so two neighbours that swap places are soon in different halves. Small graphs are settled by one task in the same rounds. `rounds` bounds them where it is given.
    A round's modularity is counted along with the first half of the next, whose moves are dropped if the rounds end there.
    """
    two_m = graph.groupBy("ws").agg(F.sum("w").alias("m2"))  # a row a workspace
    nodes = graph.groupBy("ws", F.col("a").alias("id")).agg(F.sum("w").alias("k")).join(two_m, "ws")
    if held.n <= blocks.EDGES_OF_ONE_TASK:
        return stored(nodes.join(blocks.settled_by_one(held, start, level, rounds, tol, patience), "id").select("id", "ws", "k", "m2", "label"), "louvain-state")
    state = stored(nodes.join(start, "id").select("id", "ws", "k", "m2", "label"), "louvain-state")
    best_q, idle, done = None, 0, 0
    while rounds is None or done < rounds:
        moved = 0
        for half in (0, 1):
            size = state.groupBy("label").agg(F.sum("k").alias("tot"))
            counting = half == 0 and done >= 2
            new = stored(held.run(state.join(size, "label").select("id", "label", "tot"), moves((level, done, half), counting), "id long, new long, inside double"), "louvain-moves")
            n, inside = new.agg(F.count("id"), F.coalesce(F.sum("inside"), F.lit(0.0))).first()
            if counting:
                spread = state.groupBy("label", "m2").agg(F.sum("k").alias("d")).agg(F.coalesce(F.sum(F.pow(F.col("d") / F.col("m2"), F.lit(2.0))), F.lit(0.0))).first()[0]
                q = inside - spread
                idle = 0 if best_q is None or q > best_q + tol else idle + 1
                best_q = q if best_q is None else max(q, best_q)
                if idle >= patience:
                    forget(new)
                    return state
            if n:
                last, state = state, stored(state.join(new.where("id is not null").select("id", "new"), "id", "left").select("id", "ws", "k", "m2", F.coalesce("new", "label").alias("label")), "louvain-state")
                forget(last)
            forget(new)
            moved += n
        done += 1
        if not moved:
            break
    return state


def communities(w: DataFrame, rounds: int | None = None, levels: int | None = None, passes: int = 2, tol: float = 1e-9, patience: int = 4) -> DataFrame:
    """(ws, name, label): bulk-synchronous Louvain with refinement, run to rest; a label is the least name of its community.

    Nodes move to the neighbouring community of greatest modularity gain over their own (ties: the oldest label) until none moves, or `patience` rounds in turn gain no more than `tol`. Then communities that fall apart inside are split into their
    connected parts, and the parts become the nodes of a smaller graph. The last level merges none. With more `passes` the nodes move again from the communities found, as long as that
    changes any. `rounds` a level and `levels` bound the work where they are given; every community is connected whatever they are.
    """
    base = stored(undirected(w), "louvain-names")
    names = stored(base.select("ws", F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()), "louvain-ids")
    at = lambda c, i: names.select("ws", F.col("name").alias(c), F.col("id").alias(i))
    one = base.join(at("a", "ia"), ["ws", "a"]).join(at("b", "ib"), ["ws", "b"])
    two = F.array(F.struct(F.col("ia").alias("a"), F.col("ib").alias("b")), F.struct(F.col("ib").alias("a"), F.col("ia").alias("b")))
    first = stored(one.select("ws", "w", F.explode(two).alias("e")).select("ws", "e.a", "e.b", "w"), "louvain-graph")
    forget(base)
    kept = Blocks(first)
    final = stored(names.select("id", F.col("id").alias("label")), "louvain-labels")
    for one in range(passes):
        graph, held, start, place = first, kept, final, names.select("id", F.col("id").alias("at"))  # `at`: a name's node of the level
        level = 0
        while levels is None or level < levels:
            state = _settled(graph, held, start, 1000 * one + level, rounds, tol, patience)
            roots = connected(held.run(state.select("id", "label"), tied, "label long, a long, b long").repartition("label").select("a", "b"))
            parts = stored(state.join(roots, "id", "left").select("id", "ws", F.coalesce("root", "id").alias("part")), "louvain-parts")
            place = stored(place.join(parts.select(F.col("id").alias("at"), "part"), "at").select("id", F.col("part").alias("at")), "louvain-place")
            between = held.run(parts.select("id", "part"), merged, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
            smaller = stored(between.join(parts.select(F.col("part").alias("a"), "ws").distinct(), "a").select("ws", "a", "b", "w"), "louvain-graph")
            start = parts.select(F.col("part").alias("id"), F.col("part").alias("label")).distinct()
            still = start.count() == parts.count()
            if graph is not first:
                forget(graph)
                held.forget()
            forget(state)
            graph, held, level = smaller, None, level + 1
            if still:
                break
            if levels is None or level < levels:
                held = Blocks(graph)
        label = place.select("id", F.col("at").alias("label"))
        new = stored(label.join(label.groupBy("label").agg(F.min("id").alias("least")), "label").select("id", F.col("least").alias("label")), "louvain-labels")
        same = new.join(final.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count() == 0
        forget(final)
        final = new
        if same:
            break
    kept.forget()
    named = final.join(names, "id").select("ws", "label", "name")
    return named.join(named.groupBy("ws", "label").agg(F.min("name").alias("least")), ["ws", "label"]).select("ws", "name", F.col("least").alias("label"))


def community_table(labels: DataFrame, w: DataFrame, most: int = 12, least: int = 2) -> DataFrame:
    """Communities by size: (ws, id, size, top_member)."""
    degree = _neighbours(w).groupBy("ws", F.col("a").alias("name")).agg(F.count(F.lit(1)).alias("d"))
    got = labels.join(degree, ["ws", "name"], "left").groupBy("ws", "label").agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("first"), F.min(F.struct((-F.coalesce("d", F.lit(0))).alias("d"), "name")).alias("top"))
    ranked = got.where(F.col("size") >= least).withColumn("id", F.row_number().over(W.partitionBy("ws").orderBy(F.col("size").desc(), "first")).cast("long") - 1)
    return ranked.where(F.col("id") < most).select("ws", "id", "size", F.col("top.name").alias("top_member"))


def _pairs_among(mids: DataFrame, among: DataFrame | None = None, block: int = 2_000) -> DataFrame:
    """(ws, a, c, d): pairs a < c of neighbours of each mid (ws, mid, n, d), all or those of `among` (ws, name).

    A hub's neighbours are dealt to blocks of about `block`, every two of which are paired apart, so that no task makes all pairs of a hub.
    """
    mid = mids if among is None else mids.join(among.select("ws", F.col("name").alias("n")), ["ws", "n"], "left_semi")
    mid = mid.withColumn("here", F.col("d")) if among is None else mid.join(mid.groupBy("ws", "mid").agg(F.count(F.lit(1)).alias("here")).where("here > 1"), ["ws", "mid"])
    blocks = F.ceil(F.col("here") / block).cast("int")
    mid = mid.withColumn("own", F.pmod(F.xxhash64("n"), blocks).cast("int"))
    two = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("x"), F.greatest(b, F.col("own")).alias("y")))
    mid = mid.withColumn("two", F.explode(F.when(blocks == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(two))).select("ws", "mid", "n", "d", "own", "two.x", "two.y")
    left, right = mid.withColumnRenamed("n", "a"), mid.select("ws", "mid", "x", "y", F.col("n").alias("c"), F.col("own").alias("other"))
    return left.join(right, ["ws", "mid", "x", "y"]).where("a < c and (x = y or own <> other)").select("ws", "a", "c", "d")


def _summed_links(u: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of pairs (ws, a, c, d), a row a common neighbour, that no edge of u joins."""
    got = pairs.groupBy("ws", "a", "c").agg(F.sum(1 / F.ln("d")).alias("adamic_adar"), F.sum(1 / F.col("d")).alias("resource_allocation"), F.count(F.lit(1)).alias("common"))
    return got.join(u.select("ws", "a", F.col("b").alias("c")), ["ws", "a", "c"], "left_anti")


def link_scores(w: DataFrame, max_degree: int | None = None, block: int = 2_000, among: DataFrame | None = None) -> DataFrame:
    """Non-adjacent pairs (a < c) with a common neighbour: Adamic-Adar, resource allocation and common count, in one aggregate.

    `among` (ws, name) keeps pairs of its nodes alone; their common neighbours may be any. max_degree, if given, leaves out pairs' common neighbours of more: faster, but their contributions are lost.
    """
    u = stored(undirected(w).select("ws", "a", "b"), "link-edges")
    return _summed_links(u, _pairs_among(_near_mids(u, max_degree), among, block))


def _near_mids(u: DataFrame, max_degree: int | None = None) -> DataFrame:
    """(ws, mid, n, d): each node n at each of its neighbours mid, with the degree d of that, of undirected edges (ws, a, b); mids of one neighbour are left out, as are those of more than max_degree."""
    near = u.select("ws", F.col("a").alias("mid"), F.col("b").alias("n")).unionByName(u.select("ws", F.col("b").alias("mid"), F.col("a").alias("n")))
    degree = near.groupBy("ws", "mid").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    return near.join(degree.where(F.col("d") <= max_degree) if max_degree else degree, ["ws", "mid"])


def _pairs_at(mids: DataFrame, hubs: DataFrame, block: int = 2_000) -> DataFrame:
    """(ws, a, c, d): pairs a < c of which one at least is of hubs (ws, name), at each common neighbour of degree d. A mid's neighbours are dealt to blocks that each meet its few hubs, so the pairs are at most as many as hubs times edges."""
    blocks = F.ceil(F.col("d") / block).cast("int")
    left = mids.join(hubs.select("ws", F.col("name").alias("n")), ["ws", "n"], "left_semi").select("ws", "mid", F.col("n").alias("h"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"))
    right = mids.join(hubs.select("ws", F.col("name").alias("n"), F.lit(True).alias("hub")), ["ws", "n"], "left").withColumn("part", F.pmod(F.xxhash64("n"), blocks).cast("int"))
    pairs = left.join(right, ["ws", "mid", "part"]).where("h <> n and (hub is null or h < n)")
    return pairs.select("ws", F.least("h", "n").alias("a"), F.greatest("h", "n").alias("c"), "d")


def gap_bounds(w: DataFrame, ranks: DataFrame, mids: DataFrame | None = None) -> DataFrame:
    """(ws, name, all, part, bound): no gap with an end at `name` scores more than its bound. A pair's common neighbours are at most all of either end's (`all`, what they would add), the bridge's factor at most 1.15, and the other end's rank at most the greatest, of which `part` is the node's own share."""
    mids = _near_mids(undirected(w)) if mids is None else mids
    top = ranks.groupBy("ws").agg(F.max("score").alias("most"))  # a row a workspace
    each = mids.groupBy("ws", F.col("n").alias("name")).agg(F.sum(1 / F.ln("d") + 1 / F.col("d") + 0.25).alias("all"))
    got = each.join(ranks, ["ws", "name"]).join(top, "ws").select("ws", "name", "all", (F.col("score") / F.col("most")).alias("part"))
    return got.withColumn("bound", F.col("all") * 1.15 * (2 + F.col("part")) + 1e-6)


def _scored_gaps(links: DataFrame, ranks: DataFrame, labels: DataFrame) -> DataFrame:
    at = lambda df, c, n, v: df.select("ws", F.col("name").alias(c), F.col(v).alias(n))
    top = ranks.groupBy("ws").agg(F.max("score").alias("most"))
    got = links.join(at(labels, "a", "la", "label"), ["ws", "a"], "left").join(at(labels, "c", "lc", "label"), ["ws", "c"], "left")
    got = got.join(at(ranks, "a", "ra", "score"), ["ws", "a"]).join(at(ranks, "c", "rc", "score"), ["ws", "c"]).join(top, "ws")
    same = F.col("la").eqNullSafe(F.col("lc"))
    bridge = ~same & (F.col("common") >= 2)
    score = (F.col("adamic_adar") + F.col("resource_allocation") + 0.25 * F.col("common")) * F.when(bridge, 1.15).otherwise(1.0) * (1 + F.col("ra") / F.col("most") + F.col("rc") / F.col("most"))
    return got.select("ws", "a", "c", "common", same.alias("same_community"), bridge.alias("bridge"), F.round(score, 6).alias("score"))


def research_gaps(w: DataFrame, ranks: DataFrame, labels: DataFrame, top_n: int = 10, max_degree: int | None = None, first: int = 64, pairs_an_edge: int = 16) -> DataFrame:
    """The top missing links (ws, a, c, common, same_community, bridge, score, rank) of each workspace: scores weighted by bridging communities and by rank.

    Exact without all pairs. First all pairs with an end among the `first` nodes of each workspace by rank are scored: no more than `first` times the edges. A pair of two other nodes scores at most what either end would with all of its
    neighbours in common, the bridge's factor and, as the other end, the greatest rank that is left; so only nodes that can so reach the score which top_n pairs have already reached are paired with each other. Where fewer than top_n are found, or
    those nodes would still make more than `pairs_an_edge` pairs an edge, the step is repeated with four times as many.
    """
    order = W.partitionBy("ws").orderBy(F.col("score").desc(), F.col("common").desc(), F.col("a").desc(), F.col("c").desc())
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_n)
    u = stored(undirected(w).select("ws", "a", "b"), "gap-edges")
    mids = stored(_near_mids(u, max_degree), "gap-mids")
    nodes = stored(gap_bounds(w, ranks, mids), "gap-nodes")
    place = F.row_number().over(W.partitionBy("ws").orderBy(F.desc("part"), "name"))
    size, n, edges = first, nodes.groupBy("ws").count().agg(F.max("count")).first()[0] or 0, u.count()
    while size < n:
        hubs = stored(nodes.withColumn("_n", place).where(F.col("_n") <= size).select("ws", "name"), "gap-hubs")
        found = stored(ranked(_scored_gaps(_summed_links(u, _pairs_at(mids, hubs)), ranks, labels)), "gap-found")
        least = found.groupBy("ws").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        others = nodes.join(hubs, ["ws", "name"], "left_anti")
        limits = others.groupBy("ws").agg(F.max("part").alias("other")).join(least, "ws", "left")  # a row a workspace
        most = F.col("all") * 1.15 * (1 + F.col("part") + F.col("other")) + 1e-6
        can = stored(others.join(limits, "ws").where((F.coalesce("n", F.lit(0)) < top_n) | (most >= F.col("least"))).select("ws", "name"), "gap-can")
        met = mids.join(can.withColumnRenamed("name", "n"), ["ws", "n"], "left_semi").groupBy("ws", "mid").agg(F.count(F.lit(1)).cast("double").alias("k"))
        if (met.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0) <= pairs_an_edge * edges:
            more = _scored_gaps(_summed_links(u, _pairs_among(mids, can)), ranks, labels)
            return ranked(found.drop("rank").unionByName(more))
        size *= 4
        forget(hubs, found, can)
    return ranked(_scored_gaps(_summed_links(u, _pairs_among(mids)), ranks, labels))


def ordered_gaps(gaps: DataFrame, by: str = "score", bridges_only: bool = False) -> DataFrame:
    """Gaps ranked by score, or by their common neighbours and then score; names descending; only bridges between communities where asked for."""
    first = [F.col("score").desc(), F.col("common").desc()] if by == "score" else [F.col("common").desc(), F.col("score").desc()]
    kept = gaps.where("bridge") if bridges_only else gaps
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("ws").orderBy(*first, F.col("a").desc(), F.col("c").desc())).cast("long"))


def find_gaps(gaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ranked gaps those of asked pairs (ws, source, target), unordered and in any case; a pair of one name is none."""
    key = lambda x, y: (F.least(F.lower(F.trim(x)), F.lower(F.trim(y))).alias("_x"), F.greatest(F.lower(F.trim(x)), F.lower(F.trim(y))).alias("_y"))
    asked = pairs.where(F.lower(F.trim("source")) != F.lower(F.trim("target"))).select("ws", *key("source", "target")).distinct()
    return gaps.select("*", *key("a", "c")).join(asked, ["ws", "_x", "_y"], "left_semi").drop("_x", "_y")


def why_notable(common: str = "common", bridge: str = "bridge") -> Column:
    return F.concat(F.format_string(NOTABLE, F.col(common)), F.when(F.col(bridge), ACROSS).otherwise("."))


def plain_summary(gaps: DataFrame) -> DataFrame:
    """Gaps (..., common, bridge, evidence) with a sentence for readers."""
    n = F.col("common")
    names = F.array_join(F.slice(F.filter(F.transform("evidence", lambda e: e["mid"]), lambda x: x != ""), 1, 2), ", ")
    listed = F.when(F.coalesce(names, F.lit("")) != "", F.concat(F.lit(" ("), names, F.when(n > 2, "...").otherwise(""), F.lit(")"))).otherwise("")
    noun = F.when(n == 1, "intermediary").otherwise("intermediaries")
    text = F.concat(F.lit("Both connect to "), n.cast("string"), F.lit(" shared "), noun, listed, F.lit(" but have no direct link."), F.when(F.col("bridge"), " Bridges two topic clusters.").otherwise(""))
    return gaps.withColumn("summary", F.concat(text, F.when(n == 0, F.concat(F.lit(" "), why_notable())).otherwise("")))


def gap_payload(gaps: DataFrame, types: DataFrame) -> DataFrame:
    """(ws, a, c, payload): gaps with evidence as JSON for a phrasing model; types (ws, name, label)."""
    at = lambda c: types.select("ws", F.col("name").alias(c), F.struct(F.col("name"), F.col("label").alias("type")).alias(f"_{c}"))
    rows = gaps.join(at("a"), ["ws", "a"], "left").join(at("c"), ["ws", "c"], "left")
    body = F.struct(
        F.col("_a").alias("source"), F.col("_c").alias("target"), F.col("common").alias("common_neighbor_count"), "same_community", F.col("bridge").alias("interdisciplinary"),
        F.coalesce("evidence", F.array().cast("array<struct<mid: string, from_a: array<string>, from_c: array<string>>>")).alias("shared_intermediaries"), F.lit(True).alias("unproven_missing_edge"),
    )
    return rows.select("ws", "a", "c", F.to_json(body).alias("payload"))


def guarded_hypotheses(gaps: DataFrame, phrased: DataFrame) -> DataFrame:
    """Gaps joined with what a model phrased (ws, a, c, statement, relation, confidence, reasoning, caveat): unknown relations and confidences fall back, missing texts are filled in."""
    got = gaps.join(phrased, ["ws", "a", "c"], "left")
    rel = F.when(F.col("relation").isin(*PREDICTED), F.col("relation")).otherwise(PREDICTED_ELSE)
    level = F.lower(F.col("confidence"))
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other).alias(c)
    guess = F.format_string(CONJECTURE, F.col("a"), rel, F.col("c"))
    return got.select(
        "ws", "a", "c", filled("statement", guess), rel.alias("relation"), F.when(level.isin(*CONFIDENCES), level).otherwise(CONFIDENCE_ELSE).alias("confidence"), filled("reasoning", why_notable()),
        filled("caveat", F.lit(CAVEAT)),
    )


def gap_strength(gaps: DataFrame) -> DataFrame:
    """strong from 0.66 of the workspace's top score, moderate from 0.33, else emerging."""
    top = F.max("score").over(W.partitionBy("ws"))
    return gaps.withColumn("strength", F.when(top <= 0, "emerging").when(F.col("score") / top >= 0.66, "strong").when(F.col("score") / top >= 0.33, "moderate").otherwise("emerging"))


def _roots(asked: DataFrame, mine: str) -> DataFrame:
    """(ws, root, at, hops, parent, rel): the roots of one side of the asked pairs, reached by themselves."""
    return asked.select("ws", F.col(mine).alias("root")).distinct().select("ws", "root", F.col("root").alias("at"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("rel"))


def _searched_from_few(near: DataFrame, waiting: DataFrame, side: str, hops: int) -> DataFrame:
    """(ws, a, b, hops, path, relations) of the waiting pairs that are joined, by a search from the roots of one side alone over near (ws, x, y, rel).

    The paths are those of the search from both ends: the node where the ends would have met, the least one, is carried from there on to the other end. A node k hops from a root keeps, for each length j that a path through
    it may need, the least way `t<j>` of its last j hops: nodes from the meeting one on, then their relations. Once half of the hops are done, only nodes that some waiting end can still reach are searched.
    """
    other = "b" if side == "a" else "a"
    back = lambda k: k // 2 if side == "a" else (k + 1) // 2  # noqa: E731 - hops of the other end's half
    none = F.array().cast("array<string>")
    nothing = F.struct(none.alias("nodes"), none.alias("rels"))
    at = waiting.select("ws", F.col(side).alias("root")).distinct().select("ws", "root", F.col("root").alias("at"))
    levels, read = [stored(at.withColumn("t0", nothing), "path-level")], []
    for k in range(1, hops + 1):
        legs = near
        if hops - k <= hops // 2:
            ball = waiting.select("ws", F.col(other).alias("y")).distinct()
            for _ in range(hops - k):
                ball = ball.unionByName(near.join(ball.withColumnRenamed("y", "x"), ["ws", "x"], "left_semi").select("ws", "y")).distinct()
            legs = near.join(ball, ["ws", "y"], "left_semi")
        front = levels[-1].join(waiting.select("ws", F.col(side).alias("root")).distinct(), ["ws", "root"], "left_semi").withColumnRenamed("at", "x")
        ways = lambda j: F.struct(F.concat(F.col(f"t{j - 1}.nodes"), F.array("x")).alias("nodes"), F.concat(F.col(f"t{j - 1}.rels"), F.array("rel")).alias("rels"))
        step = front.join(legs, ["ws", "x"]).groupBy("ws", "root", F.col("y").alias("at")).agg(*[F.min(ways(j)).alias(f"t{j}") for j in range(1, max(back(k), 1) + 1)])
        for seen in levels[-2:]:
            step = step.join(seen.select("ws", "root", "at"), ["ws", "root", "at"], "left_anti")
        levels.append(stored(step.withColumn("t0", nothing), "path-level"))
        way = F.col(f"t{back(k)}")
        now = waiting.join(levels[-1].select("ws", F.col("root").alias(side), F.col("at").alias(other), way.alias("way")), ["ws", side, other])
        read.append(stored(now.select("ws", "a", "b", F.lit(k).alias("hops"), F.concat("way.nodes", F.array(other)).alias("nodes"), F.col("way.rels").alias("rels")), "path-met"))
        waiting = stored(waiting.join(read[-1], ["ws", "a", "b"], "left_anti"), "path-waiting")
        if waiting.limit(1).count() == 0:
            break
    got = read[0]
    for m in read[1:]:
        got = got.unionByName(m)
    got = got.withColumn("_at", F.col("nodes")[0])
    for level in reversed(levels[1 : hops - back(hops) + 1]):
        up = level.select("ws", F.col("root").alias(side), F.col("at").alias("_at"), F.col("t1.nodes")[0].alias("_up"), F.col("t1.rels")[0].alias("_rel"))
        got = got.join(up, ["ws", side, "_at"], "left")
        put = lambda c, new: F.when(F.col("_up").isNotNull(), F.concat(F.array(new), c)).otherwise(F.col(c))
        got = got.withColumn("nodes", put("nodes", "_up")).withColumn("rels", put("rels", "_rel")).withColumn("_at", F.coalesce("_up", "_at")).drop("_up", "_rel")
    turned = (lambda c: F.col(c)) if side == "a" else F.reverse
    got = stored(got.select("ws", "a", "b", "hops", turned("nodes").alias("path"), turned("rels").alias("relations")), "path-read")
    forget(*levels, *read)
    return got


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 5, few: int = 64) -> DataFrame:
    """(ws, a, b, hops, path, relations): a shortest undirected path for each pair, as arrays, ignoring case, with the least relation of each hop; one that isn't reached in `max_hops` (1 to 8) hops has none.

    Breadth-first from both ends in turn. A root keeps each node that it reached once, with its hops and one parent (the least node of the level before), not a path. After each step the pairs whose
    two sides have met, at the least node of both levels, leave, and roots without a pair left search no further. Paths are read back along the parents of the pairs that met.
    Where one side has at most `few` roots in each workspace and the other more, that side alone is searched from, with the same paths (`_searched_from_few`): many roots at one hub would each reach all of its neighbours.
    """
    two = F.array(F.struct(F.lower("src").alias("x"), F.lower("tgt").alias("y")), F.struct(F.lower("tgt").alias("x"), F.lower("src").alias("y")))
    rel = F.col("rel") if "rel" in edges.columns else F.lit("")
    near = stored(edges.select("ws", rel.alias("rel"), F.explode(two).alias("e")).groupBy("ws", "e.x", "e.y").agg(F.min("rel").alias("rel")), "path-edges")
    asked = stored(pairs.select("ws", F.lower("a").alias("a"), F.lower("b").alias("b")).distinct(), "path-pairs")
    zero = asked.where("a = b")
    waiting = asked.where("a <> b")
    zero = zero.join(near.select("ws", F.col("x").alias("a")).distinct(), ["ws", "a"], "left_semi").select("ws", "a", "b", F.lit(0).alias("hops"), F.col("a").alias("mid"))
    hops = min(max(max_hops, 1), 8)
    roots = waiting.groupBy("ws").agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).agg(F.max("a"), F.max("b")).first()
    if min(roots[0] or 0, roots[1] or 0) <= few < max(roots[0] or 0, roots[1] or 0):
        none = F.array().cast("array<string>")
        zero = zero.select("ws", "a", "b", "hops", F.array("mid").alias("path"), none.alias("relations"))
        got = stored(zero.unionByName(_searched_from_few(near, waiting, "a" if roots[0] <= roots[1] else "b", hops)), "path-read")
        return asked.join(got, ["ws", "a", "b"], "left").select("ws", "a", "b", F.col("hops").cast("long").alias("hops"), "path", "relations")
    levels: dict[str, list[DataFrame]] = {s: [stored(_roots(waiting, s), "path-level")] for s in "ab"}
    met = [zero]
    for k in range(1, hops + 1):
        side = "ab"[(k - 1) % 2]
        front = levels[side][-1].join(waiting.select("ws", F.col(side).alias("root")).distinct(), ["ws", "root"], "left_semi")
        step = front.select("ws", "root", F.col("at").alias("x")).join(near, ["ws", "x"]).groupBy("ws", "root", F.col("y").alias("at")).agg(F.min(F.struct(F.col("x").alias("parent"), "rel")).alias("p"))
        for old in levels[side][-2:]:  # a neighbour of the last level is in it, in the one before, or new
            step = step.join(old.select("ws", "root", "at"), ["ws", "root", "at"], "left_anti")
        levels[side].append(stored(step.select("ws", "root", "at", F.lit((k + 1) // 2 if side == "a" else k // 2).alias("hops"), "p.parent", "p.rel"), "path-level"))
        ours, theirs = (levels[s][-1].select("ws", F.col("root").alias(s), "at") for s in "ab")
        now = waiting.join(ours, ["ws", "a"]).join(theirs, ["ws", "b", "at"]).groupBy("ws", "a", "b").agg(F.min("at").alias("mid"))
        met.append(stored(now.select("ws", "a", "b", F.lit(k).alias("hops"), "mid"), "path-met"))
        waiting = stored(waiting.join(met[-1], ["ws", "a", "b"], "left_anti"), "path-waiting")
        if waiting.limit(1).count() == 0:
            break
    every = met[0]
    for m in met[1:]:
        every = every.unionByName(m)
    got = every.withColumn("path", F.array("mid")).withColumn("relations", F.array().cast("array<string>"))
    for side in "ab":
        got = got.withColumn("_at", F.col("mid"))
        for level in reversed(levels[side][1:]):
            up = level.select("ws", F.col("root").alias(side), F.col("at").alias("_at"), F.col("parent").alias("_up"), F.col("rel").alias("_rel"))
            got = got.join(up, ["ws", side, "_at"], "left")
            more = F.col("_up").isNotNull()
            one, rels = (F.concat(F.array("_up"), "path"), F.concat(F.array("_rel"), "relations")) if side == "a" else (F.concat("path", F.array("_up")), F.concat("relations", F.array("_rel")))
            got = got.withColumn("path", F.when(more, one).otherwise(F.col("path"))).withColumn("relations", F.when(more, rels).otherwise(F.col("relations"))).withColumn("_at", F.coalesce("_up", "_at")).drop("_up", "_rel")
        got = stored(got.drop("_at"), "path-read")
    found = asked.join(got.drop("mid"), ["ws", "a", "b"], "left")
    forget(*[x for s in "ab" for x in levels[s]])
    return found.select("ws", "a", "b", F.col("hops").cast("long").alias("hops"), "path", "relations")


def path_types(paths: DataFrame, types: DataFrame) -> DataFrame:
    """Paths with `types`, the labels (ws, name, label) of their nodes in order, as an array; unknown nodes have an empty one."""
    one = paths.where("path is not null").select("ws", "a", "b", F.posexplode("path").alias("i", "node"))
    known = one.join(types.select("ws", F.lower("name").alias("node"), "label").groupBy("ws", "node").agg(F.min("label").alias("label")), ["ws", "node"], "left")
    got = known.groupBy("ws", "a", "b").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("label", F.lit("")).alias("label")))).alias("l"))  # nine nodes at most
    return paths.join(got.select("ws", "a", "b", F.transform("l", lambda x: x["label"]).alias("types")), ["ws", "a", "b"], "left")
