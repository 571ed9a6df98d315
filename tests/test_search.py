"""The vector index, pivots, gaps by bounds, two-sided paths, trails and communities, each against a plain version."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import analytics as A
from kgspark.operators import graph as G
from kgspark.operators import patterns as P
from kgspark.operators import resolution as E
from kgspark.operators import retrieval as R
from kgspark.operators import vindex as X


def _clusters(n=1500, d=12, k=15, spread=0.25, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, d))[rng.integers(0, k, n)] + spread * rng.normal(size=(n, d))


def test_index_finds_nearly_all_neighbours_in_few_lists(spark):
    v = _clusters()
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    odd = spark.createDataFrame([(9000, None), (9001, [0.0] * 12), (9002, [1.0]), (9003, [None] * 12)], "id long, embedding array<double>")
    index = X.build_index(rows.unionByName(odd))
    assert index.skipped == 4 and index.probes < len(index.centroids) / 2
    assert spark.read.parquet(f"{index.path}/lists").count() == len(v)
    queries = rows.where("id % 50 = 0").selectExpr("id as qid", "embedding as vector").unionByName(odd.selectExpr("id as qid", "embedding as vector"))
    found, exact = X.search_index(spark, X.Index.load(spark, index.path), queries, 8), R.vector_topk(queries, rows, 8)
    got = X.recall_at(found, exact).first()
    assert got.queries == 30 and got.recall >= 0.9
    every = lambda df: {(r.qid, r["rank"], r.id, round(r.distance, 7)) for r in df.collect()}
    assert every(X.search_index(spark, index, queries, 8, probes=len(index.centroids))) == every(exact)


def test_index_in_blocks_and_of_nothing(spark, monkeypatch):
    v = _clusters(300, 6, 3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    monkeypatch.setattr(X, "BLOCK", 40)
    index = X.build_index(rows, n_lists=3)
    queries = rows.selectExpr("id as qid", "embedding as vector")
    every = lambda df: {(r.qid, r["rank"], r.id) for r in df.collect()}
    assert every(X.search_index(spark, index, queries, 4, probes=3)) == every(R.vector_topk(queries, rows, 4))
    none = X.build_index(rows.limit(0))
    assert none.centroids == [] and X.search_index(spark, none, queries, 4).count() == 0


def test_searches_leave_out_broken_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [0.5, None])], "id long, embedding array<double>")
    assert [(r.qid, r.id) for r in R.vector_topk(rows.selectExpr("id as qid", "embedding as vector"), rows, 3).collect()] == [(1, 1)]
    names = rows.selectExpr("id as seq", "'k' as kind", "embedding")
    assert {r.seq: (r.leader, r.decision) for r in E.resolve_banded(names).collect()} == {i: (i, "new") for i in range(1, 6)}
    assert E.best_earlier(names, 0.5, 0.9).count() == 0


def test_pivots_compare_few_pairs_and_find_all(spark):
    v = _clusters(600, 8, 12, 0.1)
    rows = [(i, "xy"[i % 2], x.tolist()) for i, x in enumerate(v)]
    names = spark.createDataFrame(rows, "seq long, kind string, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    want = {(i, j) for i in range(600) for j in range(i) if i % 2 == j % 2 and sims[i, j] >= 0.9}
    assert {(r.seq, r.other) for r in E.similar_pairs(names, 0.9, 20).collect()} == want
    met = E.meeting_blocks(E.blocks_of(names, 20), 0.9).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")))).first()[0]
    assert len(want) <= met < 0.4 * (2 * 300 * 299 / 2)
    best = {r.seq: r.best for r in E.best_earlier(names, 0.5, 0.9, 20).collect()}
    assert best == {i: max(range(i % 2, i, 2), key=lambda j: (round(sims[i, j], 12), -j)) for i in range(2, 600)}


def _edges(spark, rows):
    return spark.createDataFrame([("w", "L", a, r, "L", b, c) for a, b, r, c in rows], "ws string, src_label string, src string, rel string, tgt_label string, tgt string, confidence double")


def _random_edges(n, m, seed):
    deal = random.Random(seed)
    names = [f"n{i:03d}" for i in range(n)]
    got = {}
    for _ in range(m):
        a, b = deal.choice(names[: 3 + n // 4]) if deal.random() < 0.5 else deal.choice(names), deal.choice(names)
        if a != b:
            got[a, b] = deal.choice([0.5, 1.0, 0.25])
    return [(a, b, deal.choice("XY"), c) for (a, b), c in got.items()]


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_by_bounds_equal_all_pairs(spark, seed):
    rows = _random_edges(120, 260, seed)
    w = G.weighted_edges(_edges(spark, rows)).persist()
    ranks = A.pagerank(w, iterations=5).persist()
    labels = ranks.select("ws", "name", F.substring("name", -1, 1).alias("label"))
    got = [(r.a, r.c, r.common, r.score) for r in A.research_gaps(w, ranks, labels, 7, first=8).orderBy("rank").collect()]
    near: dict[str, set] = {}
    for a, b, _, _ in rows:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    score = {r.name: r.score for r in ranks.collect()}
    most, want = max(score.values()), []
    for a, c in itertools.combinations(sorted(near), 2):
        both = near[a] & near[c]
        if both and c not in near[a]:
            s = sum(1 / math.log(len(near[m])) + 1 / len(near[m]) + 0.25 for m in both) * (1.15 if a[-1] != c[-1] and len(both) >= 2 else 1) * (1 + score[a] / most + score[c] / most)
            want.append((round(s, 6), len(both), a, c))
    want = [(a, c, k, s) for s, k, a, c in sorted(want, reverse=True)[:7]]
    assert [g[:3] for g in got] == [x[:3] for x in want] and [g[3] for g in got] == pytest.approx([x[3] for x in want], abs=2e-6)
    kept = A.gap_bounds(w, ranks).where(F.col("bound") >= got[-1][3]).count()
    assert kept < len(near)  # the others are in no pair that is scored


@pytest.mark.parametrize("hops", [1, 2, 5])
def test_paths_from_both_ends_are_shortest(spark, hops):
    rows = _random_edges(60, 55, 5) + [("A > B", "n001", "X", 1.0), ("A > B", "C", "Z", 1.0)]
    near: dict[str, dict] = {}
    for a, b, r, _ in rows:
        for x, y in ((a.lower(), b.lower()), (b.lower(), a.lower())):
            near.setdefault(x, {}).setdefault(y, set()).add(r)
    asked = [(a, b) for a in ("n000", "n005", "A > B", "absent") for b in ("N010", "n030", "c", "n041", "n055")]
    got = A.shortest_paths(_edges(spark, rows), spark.createDataFrame([("w", *p) for p in asked], "ws string, a string, b string"), hops).collect()
    assert len(got) == len(asked)
    for r in got:
        dist, front = {r.a: 0}, [r.a]
        for k in range(1, hops + 1):
            front = sorted({y for x in front for y in near.get(x, {})} - set(dist))
            dist |= dict.fromkeys(front, k)
        assert r.hops == (dist.get(r.b) if r.a in near else None)
        if r.hops is not None:
            assert r.path[0] == r.a and r.path[-1] == r.b and len(r.path) == r.hops + 1
            assert r.relations == [min(near[x][y]) for x, y in itertools.pairwise(r.path)]

@pytest.mark.parametrize("hops", [1, 2, 5, 8])
def test_paths_from_the_few_side_are_those_from_both(spark, hops):
    e, few = _edges(spark, _random_edges(60, 62, 5)), ("n000", "n005", "absent")
    ends = [f"n{i:03d}" for i in range(0, 60, 2)]
    for turn in (1, -1):
        pairs = spark.createDataFrame([("w", *(a, b)[::turn]) for a in few for b in ends], "ws string, a string, b string")
        one, both = ({(r.a, r.b): tuple(r) for r in A.shortest_paths(e, pairs, hops, few=n).collect()} for n in (3, 0))
        assert one == both and (hops == 1 or any(r[3] for r in one.values()))


def test_many_roots_at_a_hub_reach_its_neighbours_once(spark, monkeypatch):
    n, kept, write = 90, [], A.stored
    rows = [("topic", "paper", "X", 1.0), ("paper", "leaf00", "X", 1.0)] + [(f"leaf{i:02d}", "hub", "Y", 1.0) for i in range(n)]
    monkeypatch.setattr(A, "stored", lambda d, name="table", *a: kept.append((name, write(d, name, *a))) or kept[-1][1])
    monkeypatch.setattr(A, "forget", lambda *a: None)
    pairs = spark.createDataFrame([("w", "topic", f"leaf{i:02d}") for i in range(n)], "ws string, a string, b string")
    assert {r.hops for r in A.shortest_paths(_edges(spark, rows), pairs).collect()} == {2, 4}
    assert sum(d.count() for name, d in kept if name == "path-level") < 5 * n


def test_trails_by_halves_equal_a_walk(spark):
    rows = _random_edges(14, 26, 9)
    e = _edges(spark, rows)
    for directed in (True, False):
        steps = [(a, b, i) for i, (a, b, _, _) in enumerate(rows)] + ([] if directed else [(b, a, i) for i, (a, b, _, _) in enumerate(rows)])
        now, want = [(a, b, (i,)) for a, b, i in steps], {}
        for k in range(1, 6):
            want[k] = sorted((a, b) for a, b, _ in now)
            now = [(a, c, (*u, i)) for a, b, u in now for x, c, i in steps if x == b and i not in u]
        got: dict = {}
        for r in P.paths(e, ["X", "Y"], 5, directed).collect():
            got.setdefault(r.hops, []).append((r.start, r.end))
        assert {k: sorted(x) for k, x in got.items()} == {k: x for k, x in want.items() if x}


def sequential_louvain(weights):
    """Labels by the usual sequential moves and levels over undirected weights {(a, b): w}."""
    near: dict = {}
    for (a, b), w in weights.items():
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0) + w
    member = {n: n for n in near}
    while True:
        m2 = sum(sum(x.values()) for x in near.values())
        k = {n: sum(x.values()) for n, x in near.items()}
        label, tot, any_moved = {n: n for n in near}, dict(k), False
        moved = True
        while moved:
            moved = False
            for n in sorted(near):
                tot[label[n]] -= k[n]
                kin: dict = {label[n]: 0.0}
                for o, w in near[n].items():
                    if o != n:
                        kin[label[o]] = kin.get(label[o], 0) + w
                best = max(sorted(kin), key=lambda c: kin[c] - k[n] * tot[c] / m2)
                if kin[best] - k[n] * tot[best] / m2 > kin[label[n]] - k[n] * tot[label[n]] / m2 + 1e-12:
                    label[n], moved, any_moved = best, True, True
                tot[label[n]] += k[n]
        if not any_moved:
            return member
        member = {n: label[c] for n, c in member.items()}
        up: dict = {}
        for a, x in near.items():
            for b, w in x.items():
                row = up.setdefault(label[a], {})
                row[label[b]] = row.get(label[b], 0) + w
        near = up


def _sequential_runs(weights, n=9):
    """Sequential labellings with the nodes in order and in shuffled orders."""
    names = sorted({x for p in weights for x in p})
    for seed in range(n):
        order = list(names)
        if seed:
            random.Random(seed).shuffle(order)
        code = {x: f"{i:03d}" for i, x in enumerate(order)}
        got = sequential_louvain({(code[a], code[b]): w for (a, b), w in weights.items()})
        yield {x: got[code[x]] for x in names}


def modularity(weights, label):
    m, inside, degree = sum(weights.values()), 0.0, {}
    for (a, b), w in weights.items():
        inside += w if label[a] == label[b] else 0
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + w
    return inside / m - sum(d * d for d in degree.values()) / (4 * m * m)


def _literal_graphs():
    ring = {(f"{g}{i}", f"{g}{j}"): 1.0 for g in "abcdef" for i in range(5) for j in range(i)} | {(f"{x}0", f"{y}1"): 1.0 for x, y in zip("abcdef", "bcdefa", strict=True)}
    grid = {(f"{i}{j}", f"{i + di}{j + dj}"): 1.0 + 0.1 * ((i * 7 + j * 3) % 4) for i in range(6) for j in range(6) for di, dj in ((0, 1), (1, 0)) if i + di < 6 and j + dj < 6}
    deal = random.Random(8)
    blocks = {(min(a, b), max(a, b)): 1.0 for a in range(48) for b in range(48) if a < b and deal.random() < (0.5 if a // 12 == b // 12 else 0.04)}
    stars = {(f"{g}hub", f"{g}{i}"): 1.0 + i / 10 for g in "abcde" for i in range(9)} | {(f"{x}hub", f"{y}hub"): 2.0 for x, y in itertools.combinations("abcde", 2)} | {(f"{x}0", f"{y}1"): 0.5 for x, y in zip("abcde", "bcdea", strict=True)}
    return {"ring of cliques": ring, "stars": stars, "grid": grid, "blocks": {(f"v{a:02d}", f"v{b:02d}"): w for (a, b), w in blocks.items()}}


@pytest.mark.parametrize("name", list(_literal_graphs()))
def test_communities_are_connected_and_no_worse_than_sequential_moves(spark, name):
    weights = _literal_graphs()[name]
    w = spark.createDataFrame([("w", a, b, x) for (a, b), x in weights.items()], "ws string, s string, t string, w double")
    got = A.communities(w).persist()
    label = {r.name: r.label for r in got.collect()}
    assert set(label) == {n for p in weights for n in p}
    reach = {n: n for n in label}
    while True:  # least reachable name inside the community
        new = {n: min([reach[n], *(reach[o] for p in weights if n in p for o in p if label[o] == label[n])]) for n in label}
        if new == reach:
            break
        reach = new
    assert reach == label
    plain = sorted(modularity(weights, labels) for labels in _sequential_runs(weights))
    assert A.modularity(w, got).first().q == pytest.approx(modularity(weights, label), abs=1e-9)
    assert modularity(weights, label) >= plain[0 if name == "grid" else -1] - 1e-9  # a grid has no communities of its own, and sequential runs differ there by chance


def test_exact_search_holds_bounded_matrices(spark):
    import random

    from kgspark.operators import retrieval as R

    rng = random.Random(3)
    held = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    held += [(1000 + i, v) for i, v in held]  # copies: ties
    chunks = spark.createDataFrame(held, "id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(held[:90], "qid long, vector array<double>")
    rows = lambda df: sorted((r.qid, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())
    got = rows(R.vector_topk(queries, chunks, 5, rows_at_once=3, queries_at_once=7))
    assert got == rows(R.vector_topk(queries, chunks, 5)) and len(got) == 90 * 5
    assert {(q, r): i for q, r, i, _ in got}[(7, 1)] == 7 and {(q, r): i for q, r, i, _ in got}[(7, 2)] == 1007
