import re

import pytest
from pyspark.sql import functions as F

from kgspark.operators import analytics as A
from kgspark.operators import graph as G
from kgspark.operators import resolution as E
from kgspark.operators import retrieval as R


def edges(spark, rows):
    return spark.createDataFrame([("w", "Concept", s, r, "Concept", t, "d", c) for s, t, r, c in rows], "ws string, src_label string, src string, rel string, tgt_label string, tgt string, doc string, confidence double")


def test_parallel_edges_are_summed_and_loops_dropped(spark):
    e = edges(spark, [("A", "B", "X", 0.5), ("A", "B", "Y", 0.4), ("A", "A", "X", 1.0), ("", "B", "X", 1.0), ("B", "C", "X", 0.0)])
    assert {(r.s, r.t): round(r.w, 6) for r in G.weighted_edges(e).collect()} == {("A", "B"): 0.9, ("B", "C"): 1.0}


def test_star_hub_ranks_first(spark):
    w = G.weighted_edges(edges(spark, [(x, "HUB", "X", 1.0) for x in "ABCD"]))
    got = {r.name: r.score for r in A.pagerank(w).collect()}
    assert max(got, key=got.get) == "HUB" and abs(sum(got.values()) - 1) < 1e-3


def test_two_triangles_are_two_communities(spark):
    rows = [("a1", "a2", "X", 1.0), ("a2", "a3", "X", 1.0), ("a1", "a3", "X", 1.0), ("b1", "b2", "X", 1.0), ("b2", "b3", "X", 1.0), ("b1", "b3", "X", 1.0), ("a1", "b1", "X", 0.1)]
    w = G.weighted_edges(edges(spark, rows))
    assert [r["size"] for r in A.community_table(A.communities(w, rounds=3, levels=2), w).collect()] == [3, 3]


def test_first_gap_of_open_triangles(spark):
    w = G.weighted_edges(edges(spark, [(a, b, "X", 1.0) for a, b in ("AB", "BC", "AD", "DC", "AE", "EF", "AF")]))
    got = A.research_gaps(w, A.pagerank(w), A.communities(w, rounds=2, levels=1)).orderBy("rank").collect()
    assert (got[0].a, got[0].c, got[0].common) == ("A", "C", 2) and ("A", "F") not in {(r.a, r.c) for r in got}


def test_removal_equals_rebuilding(spark):
    c = spark.createDataFrame([("w", s, i, "P", "a", "R", "P", t, "d", 1.0) for i, (s, t) in enumerate([("s1", "b"), ("s2", "b"), ("s1", "c")])], "ws string, source_id string, seq long, src_label string, src string, rel string, tgt_label string, tgt string, doc string, confidence double")
    assert [r.tgt for r in G.build_edges(G.remove_source(c, "w", "s1")).collect()] == ["b"]
    assert G.removal_counts(c, "w", "s1").first().asDict() == {"nodes_removed": 1, "edges_removed": 1}


def test_shortest_path(spark):
    e = edges(spark, [("A", "B", "X", 1.0), ("B", "C", "X", 1.0), ("A", "D", "X", 1.0)])
    got = A.shortest_paths(e, spark.createDataFrame([("w", "d", "C"), ("w", "a", "z")], "ws string, a string, b string"))
    types = spark.createDataFrame([("w", n, f"L{n}") for n in "ABC"], "ws string, name string, label string")
    assert {(r.a, r.b): (r.hops, r.path, r.relations, r.types) for r in A.path_types(got, types).collect()} == {("d", "c"): (3, ["d", "a", "b", "c"], ["X"] * 3, ["", "LA", "LB", "LC"]), ("a", "z"): (None, None, None, None)}


def loop(rows, low, high, same):
    """Sequential resolution in Python: (leader, decision) of each name."""
    import numpy as np

    unit = lambda v: np.array(v) / np.linalg.norm(v)
    led, out = {}, {}
    for seq, kind, v in sorted(rows):
        best = max(((float(unit(v) @ unit(u)), -s) for s, (k, u) in led.items() if k == kind), default=None)
        sim, other = (best[0], -best[1]) if best else (-9, None)
        if sim >= high:
            out[seq] = (other, "auto_merge")
        elif sim >= low and same is not None and same(seq, other):
            out[seq] = (other, "adjudicated_merge")
        else:
            led[seq] = (kind, v)
            out[seq] = (seq, "new" if sim < low else "unadjudicated" if same is None else "adjudicated_new")
    return out


def test_resolution_equals_the_loop(spark, monkeypatch):
    import random

    deal = random.Random(2)
    rows = [(i, deal.choice("xy"), [deal.random(), deal.random(), deal.random() * 0.5]) for i in range(60)]
    names = spark.createDataFrame(rows, "seq long, kind string, embedding array<double>")
    monkeypatch.setattr(E.similar_pairs, "__defaults__", (7,))  # many blocks
    even = lambda seq, other: (seq + other) % 2 == 0
    got = E.resolve_banded(names, 0.8, 0.97, lambda p: p.selectExpr("seq", "(seq + other) % 2 = 0 as same"))
    assert {r.seq: (r.leader, r.decision) for r in got.collect()} == loop(rows, 0.8, 0.97, even)
    assert {r.seq: (r.leader, r.decision) for r in E.resolve_banded(names, 0.8, 0.97).collect()} == loop(rows, 0.8, 0.97, None)
    assert {r.seq: r.leader for r in E.resolve(names, 0.9).collect()} == {k: v for k, (v, _) in loop(rows, 0.9, 0.9, None).items()}


def test_resolution_in_batches_equals_the_loop(spark):
    import random

    deal = random.Random(5)
    rows = [(i, deal.choice("xy"), [deal.gauss(0, 1) for _ in range(4)]) for i in range(50)]
    rows += [(100 + i, k, v) for i, k, v in rows] + [(200 + i, k, [x + deal.gauss(0, 0.1) for x in v]) for i, k, v in rows]
    names = spark.createDataFrame([*rows, (300, "x", None), (301, "x", [0.0] * 4)], "seq long, kind string, embedding array<double>")
    even = lambda seq, other: (seq + other) % 2 == 0
    got = {r.seq: (r.leader, r.decision) for r in E.resolve_banded(names, 0.5, 0.9, lambda p: p.selectExpr("seq", "(seq + other) % 2 = 0 as same"), batch=40).collect()}
    assert got == loop(rows, 0.5, 0.9, even) | {300: (300, "new"), 301: (301, "new")}


def test_blank_names_pass_through(spark):
    names = spark.createDataFrame([(0, "k", " ", [1.0, 0.0]), (1, "k", "a", [1.0, 0.0]), (2, "k", "b", [1.0, 0.0])], "seq long, kind string, name string, embedding array<double>")
    got = E.resolve_banded(names)
    assert {r.seq: (r.leader, r.decision) for r in got.collect()} == {0: (0, "blank"), 1: (1, "new"), 2: (1, "auto_merge")}
    assert {r.decision: r.n for r in E.decision_counts(got).collect()} == {"blank": 1, "new": 1, "auto_merge": 1}


def test_topk_in_blocks_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(300, 8))
    v[7] = v[3]  # a tie
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(5)
    q = rows.where("id % 50 = 0 or id = 3").selectExpr("id as qid", "embedding as vector")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for size in (16 << 20, 100):
        got = {}
        for r in R.vector_topk(q, rows, 4, size).collect():
            got.setdefault(r.qid, {})[r.rank] = r.id
        want = {i: [int(j) for j in np.lexsort((np.arange(300), np.round(1 - u @ u[i], 12)))[:4]] for i in [*range(0, 300, 50), 3]}
        assert {k: [x[n] for n in (1, 2, 3, 4)] for k, x in got.items()} == want
    assert R.vector_topk(q, rows.limit(0), 4).count() == 0 and R.vector_topk(q.limit(0), rows, 4).count() == 0


def test_rerank_keeps_order_where_scores_fail(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.1), (1, 2, "b", 0.9), (1, 3, "c", 0.5), (2, 1, "a", 0.1), (3, 1, "a", 0.2), (3, 2, "b", None), (4, 1, "a", 0.5), (4, 2, "b", 0.5)], "qid long, rank long, id string, s double")
    order = lambda got: {q: [r.id for r in sorted((x for x in got if x.qid == q), key=lambda r: r.rank)] for q in (1, 2, 3, 4)}
    from pyspark.sql import functions as F

    assert order(R.rerank(hits, F.col("s"), 2).collect()) == {1: ["b", "c"], 2: ["a"], 3: ["a", "b"], 4: ["a", "b"]}
    assert order(R.rerank(hits, None, 2).collect()) == {1: ["a", "b"], 2: ["a"], 3: ["a", "b"], 4: ["a", "b"]}


def test_conflicts_are_counted_without_pairs(spark):
    rows = [("w", "a", r, "b", d) for r, ds in (("SUPPORTS", "xxyz"), ("CONTRADICTS", "xyy")) for d in ds] + [("w", "c", "SUPPORTS", "d", "x"), ("w", "c", "CONTRADICTS", "d", "x"), ("w", "e", "SUPPORTS", "f", None), ("w", "e", "CONTRADICTS", "f", "x")]
    claims = spark.createDataFrame(rows, "ws string, src string, rel string, tgt string, doc string")
    from kgspark.operators import patterns as P

    pairs = sum(1 for _, s, r, t, d in rows for _, s2, r2, t2, d2 in rows if (s, t) == (s2, t2) and r == "SUPPORTS" and r2 == "CONTRADICTS" and d and d2 and d != d2)
    assert [(r.src, r.matches) for r in P.detect_conflicts(claims).collect()] == [("a", pairs)]


def test_ranks_of_converged_and_counted_rounds(spark):
    w = G.weighted_edges(edges(spark, [(a, b, "X", c) for a, b, c in (("A", "B", 0.5), ("B", "C", 1.0), ("C", "A", 1.0), ("D", "A", 0.2), ("A", "E", 0.7))]))
    score = {n: 0.2 for n in "ABCDE"}
    out = {"A": {"B": 0.5 / 1.2, "E": 0.7 / 1.2}, "B": {"C": 1}, "C": {"A": 1}, "D": {"A": 1}}
    for _ in range(7):
        lost = sum(s for n, s in score.items() if n not in out)
        score = {n: 0.85 * (sum(score[m] * t.get(n, 0) for m, t in out.items()) + lost / 5) + 0.03 for n in score}
    got = {r.name: r.score for r in A.pagerank(w, iterations=7).collect()}
    assert all(abs(got[n] - score[n]) < 1e-9 for n in score)
    asked = spark.createDataFrame([("w", n) for n in "AE"], "ws string, name string")
    place = {n: i + 1 for i, n in enumerate(sorted(score, key=lambda n: (-score[n], n)))}
    assert {r.name: r.place for r in A.influence_for(A.pagerank(w, iterations=7), asked).collect()} == {n: place[n] for n in "AE"}


def test_communities_beat_simple_labellings(spark):
    import random

    deal = random.Random(4)
    rows = [(f"{g}{deal.randrange(8)}", f"{g}{deal.randrange(8)}", "X", 1.0) for g in "abc" for _ in range(40)] + [(f"a{i}", f"b{i}", "X", 0.3) for i in range(3)]
    w = G.weighted_edges(edges(spark, rows))
    got = A.communities(w)
    own = got.selectExpr("ws", "name", "name as label")
    q = lambda labels: A.modularity(w, labels).first().q
    assert q(got) > 0.5 > q(own) and q(got) >= q(got.selectExpr("ws", "name", "substr(name, 1, 1) as label")) - 1e-9


def test_gap_texts_and_guards(spark):
    g = spark.createDataFrame([("w", "A", "C", 3, True, False, 1.0, ["x", "y", "z"]), ("w", "B", "D", 1, False, True, 0.5, ["x"])], "ws string, a string, c string, common long, bridge boolean, same_community boolean, score double, mids array<string>")
    g = g.selectExpr("*", "transform(mids, m -> named_struct('mid', m, 'from_a', array('R'), 'from_c', array('S'))) as evidence")
    assert [r.summary for r in A.plain_summary(g).orderBy("a").collect()] == ["Both connect to 3 shared intermediaries (x, y...) but have no direct link. Bridges two topic clusters.", "Both connect to 1 shared intermediary (x) but have no direct link."]
    said = spark.createDataFrame([("w", "A", "C", "s", "LIKES", "HIGH", None, "")], "ws string, a string, c string, statement string, relation string, confidence string, reasoning string, caveat string")
    got = {r.a: r for r in A.guarded_hypotheses(g, said).collect()}
    assert (got["A"].statement, got["A"].relation, got["A"].confidence) == ("s", "SUPPORTS", "high") and got["A"].reasoning.startswith("3 shared intermediaries")
    assert got["B"].statement == "CONJECTURE: B may have an untested SUPPORTS relationship with D." and got["B"].confidence == "medium" and got["B"].caveat == A.CAVEAT


def test_prf(spark):
    d = spark.createDataFrame([(True, True), (True, True), (True, False), (False, True), (False, False)], "predicted boolean, actual boolean")
    r = R.prf(d).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1)


def test_hubs_are_paired_in_blocks(spark):
    w = G.weighted_edges(edges(spark, [("H", f"n{i}", "X", 1.0) for i in range(30)] + [("n1", "n2", "X", 1.0), ("n3", "m", "X", 1.0), ("n4", "m", "X", 1.0)]))
    rows = lambda df: {(r.a, r.c): (round(r.adamic_adar, 9), round(r.resource_allocation, 9), r.common) for r in df.collect()}
    whole = rows(A.link_scores(w))
    assert whole == rows(A.link_scores(w, block=4)) and len(whole) == 30 * 29 // 2 - 1 + 1 and whole["n3", "n4"][2] == 2


def test_gaps_pair_no_leaves_of_a_hub(spark, monkeypatch):
    """Leaves share the hub alone, but their bounds with the greatest rank reach the score of the top gap, so that they were paired with each other."""
    made, sums = [], A._summed_links
    monkeypatch.setattr(A, "_summed_links", lambda u, pairs: (made.append(pairs.count()), sums(u, pairs))[1])
    star = [(f"n{i:03}", "H", 1.0) for i in range(200)] + [(f"n{i:03}", f"x{i:03}", 1.0) for i in range(200)] + [(f"x{i:03}", "K", 1.0) for i in range(6)]
    w = spark.createDataFrame([("w", *e) for e in star], "ws string, s string, t string, w double")
    ranks = w.select("ws", F.explode(F.array("s", "t")).alias("name")).distinct().withColumn("score", F.when(F.col("name") == "H", 1.0).when(F.col("name") == "K", 0.5).otherwise(0.01))
    labels = ranks.select("ws", "name", F.lit("one").alias("label"))
    got = A.research_gaps(w, ranks, labels, top_n=1, first=2).collect()
    assert [(r.a, r.c, r.common) for r in got] == [("H", "x199", 1)] and max(made) < 1_000  # all pairs of leaves are 19,900


def test_pagerank_broadcasts_no_table_that_grows(spark, monkeypatch):
    """Written ranks compress to almost nothing, so that Spark would send them to the driver; only a row a workspace may go there."""
    plans, write = [], A.stored

    def seen(df, name="table", **more):
        if name.startswith("rank"):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, name, **more)

    monkeypatch.setattr(A, "stored", seen)
    w = spark.createDataFrame([("w", "a", "b", 1.0), ("w", "b", "c", 2.0), ("w", "c", "a", 1.0), ("w", "c", "d", 1.0)], "ws string, s string, t string, w double")
    got = A.pagerank(w, iterations=3)
    plans.append(got._jdf.queryExecution().sparkPlan().toString())
    assert sum(r.score for r in got.collect()) == pytest.approx(1.0)
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert all(re.search(r"BroadcastHashJoin \[ws#\d+\], \[ws#\d+\]", line) for line in joins), joins


def test_modularity_reads_edges_and_labels_once(spark):
    w = spark.createDataFrame([("w", "a", "b", 1.0), ("w", "b", "c", 2.0), ("w", "d", "c", 1.0), ("w", "c", "d", 2.0)], "ws string, s string, t string, w double")
    labels = spark.createDataFrame([("w", "a", "x"), ("w", "b", "x"), ("w", "c", "y")], "ws string, name string, label string")
    got = A.modularity(w, labels)
    assert "LogicalRDD" not in got._jdf.queryExecution().optimizedPlan().toString()  # only the weights between labels are left to read
    assert got.first().q == pytest.approx(2 / 12 - (4**2 + 5**2) / 12**2)  # d has no label


def test_claims_of_large_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    from kgspark.plans import fixtures

    at = "/root/testdata/sf0.001"
    few = fixtures.claims(spark, at)
    plain = few.groupBy(*fixtures.CLAIM).count().collect()
    monkeypatch.setattr(fixtures, "LINES_AT_ONCE", 1 << 12)
    many = fixtures.claims(spark, at)
    assert many.rdd.getNumPartitions() >= 4 * few.rdd.getNumPartitions()
    assert sorted(map(repr, many.groupBy(*fixtures.CLAIM).count().collect())) == sorted(map(repr, plain))


@pytest.mark.parametrize("name", ["set_5_untagged_removed", "set_6_documents_deleted"])
def test_deletions_read_written_tables_alone(spark, name):
    from kgspark.plans import registry

    got = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert got.inputFiles() and all("/upkeep-" in f for f in got.inputFiles())


def test_connections_join_only_edges_at_asked_names(spark, monkeypatch):
    from kgspark.operators import patterns as P

    kept, write = {}, P.stored
    monkeypatch.setattr(P, "stored", lambda df, name="table", **more: kept.setdefault(name, write(df, name, **more)))
    rows = [("w", "p", "m", "X"), ("w", "m", "q", "X"), ("w", "q", "p", "Y"), ("w", "n", "p", "X"), ("w", "n", "q", "X"), ("w", "n", "q", "X"), ("v", "p", "m", "X")] + [("w", f"x{i}", f"y{i}", "X") for i in range(50)]
    edges = spark.createDataFrame(rows, "ws string, src string, tgt string, rel string")
    got = P.connections(edges, spark.createDataFrame([("w", "p", "q"), ("w", "p", "z"), ("v", "p", "q")], "ws string, a string, b string"))
    assert {(r.ws, r.a, r.b): (r.direct, r.shared, r.n_shared) for r in got.collect()} == {("w", "p", "q"): (True, "m,n", 2), ("w", "p", "z"): (False, "", 0), ("v", "p", "q"): (False, "", 0)}
    assert kept["connection-legs"].count() == 7  # of 112 ends


@pytest.mark.parametrize("name", ["join_12_entity_context", "sink_3_checked_ends", "fil_2_graph_edges"])
def test_claims_are_aggregated_once(spark, name, monkeypatch):
    """What is derived from edges or asked of them several times is written once: the result reads no table of the input again."""
    from kgspark.operators import patterns as P
    from kgspark.plans import answer_queries, kg_queries, registry

    plans, write = [], P.stored

    def seen(df, *a, **more):
        plans.append(df)
        return write(df, *a, **more)

    for m in (P, kg_queries, answer_queries):
        monkeypatch.setattr(m, "stored", seen)
    got = registry.queries()[name](spark, "/root/testdata/sf0.001")
    read = [sum("lineitem" in f for f in df.inputFiles()) for df in [*plans, got]]
    assert sum(read) == (2 if name == "join_12_entity_context" else 1), read


def test_communities_of_blocks_equal_those_of_one_task(spark, monkeypatch):
    """A round sends nodes to blocks and no row for each edge; blocks of a few edges find the communities that one task finds."""
    import random

    from kgspark.operators import blocks as B

    deal, sent = random.Random(7), []
    rows = [(f"{g}{deal.randrange(9)}", f"{g}{deal.randrange(9)}", "X", deal.choice([1.0, 0.5])) for g in "abcd" for _ in range(30)] + [(f"{g}1", "b2", "X", 0.3) for g in "acd"]
    w = G.weighted_edges(edges(spark, rows))
    got = lambda: {(r.name, r.label) for r in A.communities(w, passes=1, tol=1e-3, patience=1).collect()}
    one = got()
    monkeypatch.setattr(B, "EDGES_OF_ONE_TASK", 0)
    monkeypatch.setattr(B, "EDGES_A_BLOCK", 60)
    run = B.Blocks.run
    monkeypatch.setattr(B.Blocks, "run", lambda self, told, *a: sent.append((self.parts, self.n, told.join(self.names, "id").agg(F.sum(F.size("ps"))).first()[0])) or run(self, told, *a))
    assert got() == one and 1 < len({label for _, label in one}) < len(one) and sent[0][0] > 1 and all(rows <= 2 * n for _, n, rows in sent)


def test_contracted_edges_keep_components(spark):
    import random

    from kgspark.operators.blocks import contracted

    deal = random.Random(5)
    rows = [(deal.randrange(60), deal.randrange(60)) for _ in range(45)] + [(99, 99)]
    e = spark.createDataFrame(rows, "a long, b long").repartition(3)
    root = {x: x for r in rows for x in r}
    for _ in root:
        for a, b in rows:
            root[a] = root[b] = min(root[a], root[b])
    few = contracted(e, 10)
    assert few.count() < len(rows) and {(r.id, r.root) for r in A.connected(e).collect()} == set(root.items())


def test_large_connections_broadcast_nothing_that_grows(spark, monkeypatch):
    """Many names are not sent to the driver, nor are large tables' orders, customers and suppliers by the joins of the claims."""
    from kgspark.operators import patterns as P
    from kgspark.plans import fixtures

    monkeypatch.setattr(P, "MOST_SENT", 1)
    plans, write = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, name="table", **more: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df, name, **more))
    e = spark.createDataFrame([("w", "p", "m", "X"), ("w", "m", "q", "X"), ("w", "q", "p", "Y")], "ws string, src string, tgt string, rel string")
    got = P.connections(e, spark.createDataFrame([("w", "p", "q"), ("w", "p", "z")], "ws string, a string, b string"))
    assert {(r.b, r.direct, r.shared) for r in got.collect()} == {("q", True, "m"), ("z", False, "")}
    monkeypatch.setattr(fixtures, "SENT_UP_TO", 0)
    plans += [x._jdf.queryExecution().sparkPlan().toString() for x in (got, fixtures.claims(spark, "/root/testdata/sf0.001"))]
    assert len(plans) == 6 and not any("Broadcast" in p for p in plans)


def test_deleted_documents_make_claims_once(spark, monkeypatch):
    """Nodes come from the written edges, not from the claims again."""
    from kgspark.plans import upkeep_queries as Q
    from kgspark.plans.fixtures import claims

    kept, write = {}, Q.stored
    monkeypatch.setattr(Q, "stored", lambda df, name="table", **more: kept.setdefault(name, (df._jdf.queryExecution().optimizedPlan().toString(), write(df, name, **more)))[1])
    c = claims(spark, "/root/testdata/sf0.001")
    Q.set_6(c)
    assert "c_custkey" in kept["upkeep-edges"][0] and "c_custkey" not in kept["upkeep-nodes"][0]
    assert kept["upkeep-nodes"][1].count() == G.build_nodes(c).count()
