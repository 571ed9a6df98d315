"""Near-duplicate groups, ranked search and the prefix trie against brute force, with their defined cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import bagsearch, superminhash, trie

WORDS = [f"w{i}" for i in range(400)]


def _text(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) for _ in range(n)]


def _near(rng: random.Random) -> list[tuple[int, str | None]]:
    """Groups of copies with few and with many edits, texts that share a long passage, short and wordless texts."""
    rows: list[str | None] = [None, "", " \t\n", "one", "ONE", "one two", "one  two", "é é two", "a a a a", "a a"]
    for n in (8, 40, 300):
        base = _text(rng, n)
        for edits in [0, 0, 1, 1, 2, 3, *range(4, n // 8 + 5, max(1, n // 40))]:
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(n)] = rng.choice(WORDS)
            rows.append(" ".join(words))
    passage = _text(rng, 120)
    rows += [" ".join(passage + _text(rng, 40)) for _ in range(40)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(1000 + 7 * i, rows[k]) for i, k in enumerate(order)]


def plain_super_minhash(elements: list[int], m: int) -> list[tuple[int, int]]:
    """(step, fraction) of each register, one element and step at a time and without early stopping."""
    best = [(m, 0)] * m
    for e in elements:
        perm = list(range(m))
        for j in range(m):
            x = int(superminhash._mix(np.array([(e + 0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64], np.uint64))[0])
            k = j + ((x & 0xFFFFFF) * (m - j) >> 24)
            perm[j], perm[k] = perm[k], perm[j]
            best[perm[j]] = min(best[perm[j]], (j, x >> 24))
    return best


def test_signatures_equal_a_plain_super_minhash():
    rng = random.Random(3)
    sets = [np.array(sorted(rng.getrandbits(64) for _ in range(n)), np.uint64) for n in (1, 2, 7, 60, 500)]
    for m in (8, 24):
        got = superminhash.signatures(sets, m)
        want = [[j + f * 2.0**-40 for j, f in plain_super_minhash(s.tolist(), m)] for s in sets]
        assert (got == superminhash._mix(np.array(want).view(np.uint64))).all()


def test_signature_likeness_is_jaccard():
    rng = np.random.default_rng(5)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 50, 50))
    got = superminhash.signatures([np.unique(np.concatenate(x)) for x in ((both, a), (both, b))], 2048)
    assert (got[0] == got[1]).mean() == pytest.approx(0.8, abs=0.04)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicate_groups_equal_brute_force(spark, seed):
    rows = _near(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit("x")).withColumn("label", F.lit(1)).repartition(5)
    got = superminhash.groups(df).collect()
    want = {d: (n, c) for d, n, c in superminhash.brute_force(rows)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = superminhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if d == c)


def test_buckets_that_hold_several_components_are_compared_whole(spark):
    """Three texts in one bucket of which only the later two are linked, and a bucket above the limit in blocks."""
    sets = [list(range(100)), list(range(50, 150)), list(range(52, 152)), *[list(range(60 + i // 4, 160 + i // 4)) for i in range(9)]]
    rows = [(i, superminhash.packed(np.array(s, np.uint64)), len(s)) for i, s in enumerate(sets)]
    tokens = spark.createDataFrame(rows, "uid long, tokens binary, n long")
    buckets = tokens.select(F.lit(5).cast("long").alias("key"), F.lit(0).cast("long").alias("lead"), F.lit(len(sets)).cast("long").alias("size"), "uid", "n")
    none = spark.createDataFrame([], "a long, label long")
    for limit in (3000, 4):
        found = superminhash._rest(buckets, none, tokens.select("uid", "tokens"), 80, limit)
        label = {r.a: r.label for r in superminhash.components(found).collect()}
        assert label == dict.fromkeys(range(1, len(sets)), 1)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    t = "some words that are said twice here"
    rows = [(None, t), (4, t), (4, t), (None, "alone it is"), (9, None), (9, "")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in superminhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, 6, 4, False): 1, (4, 6, 4, True): 2, (None, 2, None, True): 1, (9, 0, 9, True): 2})


def _corpus() -> tuple[list, list]:
    rng = random.Random(11)
    docs = [(i, " ".join(_text(rng, rng.randrange(1, 60)))) for i in range(150)]
    docs += [(200 + i, docs[i % 3][1]) for i in range(90)]  # classes of 30 copies
    docs += [(300 + i, docs[5][1] + f" other{i}") for i in range(30)]  # equal bags that differ in words that no item has
    docs += [(None, docs[0][1]), (400, None), (401, ""), (402, "?!"), (403, "W1 w1 w1 été w2"), (403, "W1 w1 w1 été w2"), (404, "w7 " * 3000)]
    items = [(i, " ".join(_text(rng, rng.randrange(1, 15)))) for i in range(25)]
    items += [(50, docs[0][1]), (51, "w1 w1 été"), (52, ""), (53, None), (54, "nothing known"), (51, "w2"), (None, "w3 w3"), (55, "w7")]
    return docs, items


@pytest.mark.parametrize(("top", "block", "cells"), [(20, bagsearch.BLOCK_TERMS, bagsearch.CELLS), (3, 40, bagsearch.CELLS), (20, 40, 500)])
def test_search_equals_brute_force(spark, monkeypatch, top, block, cells):
    monkeypatch.setattr(bagsearch, "CELLS", cells)
    monkeypatch.setattr(bagsearch, "POSTINGS", cells)
    docs, items = _corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("bag", F.lit("x")).repartition(7)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0))
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in bagsearch.search(d, i, top, block).collect())
    assert got == Counter(bagsearch.brute_force(docs, items, top))


def test_search_scores_each_class_once(spark):
    docs, items = _corpus()
    d = spark.createDataFrame([x for x in docs if x[0] is not None and 300 <= x[0] < 330], "doc_id long, text string")
    terms = bagsearch.item_terms(spark.createDataFrame(items, "item_id long, text string")).collect()
    held = bagsearch.bags(d, sorted({t for r in terms for t in r.terms}))
    assert held.count() == 30 and held.select("n", "bag").distinct().count() == 1


def test_search_in_empty_tables(spark):
    docs, items = _corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert bagsearch.search(d.limit(0), i).count() == 0
    assert bagsearch.search(d, i.limit(0)).count() == 0


def _talks(rng: random.Random, n: int) -> dict[int, list[tuple[str, str]]]:
    """Conversations that share prefixes, some of them whole, one of them long."""
    got: dict[int, list] = {}
    for c in range(n):
        t = list(rng.choice(list(got.values()))) if got and rng.random() < 0.7 else []
        t = t[: rng.randrange(len(t) + 1)] + [(rng.choice("ab"), "xyz"[: rng.randrange(4)] + "é" * rng.randrange(2)) for _ in range(rng.randrange(4))]
        got[c * 3 - 20] = t
    got[1000] = [("a", "x")] * 70
    for c in range(2000, 2012):
        got[c] = got[1000]
    return got


def _frame(spark, talks):
    rows = [(c, [(True, i, f"{role}|{text}", len(text)) for i, (role, text) in enumerate(t)]) for c, t in talks.items()]
    convs = spark.createDataFrame(rows, "conv_id long, turns array<struct<known: boolean, turn: long, id: string, chars: int>>")
    return convs.withColumn("turns", F.transform("turns", lambda t: F.struct(t["known"].alias("known"), t["turn"].alias("turn"), F.md5(t["id"]).alias("id"), t["chars"].alias("chars"))))


@pytest.mark.parametrize(("seed", "n", "cells"), [(1, 60, trie.CELLS), (2, 60, 1), (3, 50, 40), (4, 1, 1)])
def test_trie_equals_brute_force(spark, seed, n, cells):
    talks = _talks(random.Random(seed), n)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = Counter(tuple(r[c] for c in names) for r in trie.trie(_frame(spark, talks), cells).collect())
    assert got == Counter(trie.brute_force(talks).values())


def test_trie_of_turns_with_nulls_and_ties(spark):
    rows = [(100, None, None, "first"), (100, 1, "user", None), (100, 1, "user", None), (101, 0, "", "first"), (101, 5, "user", ""), (101, 6, "user", ""), (None, 0, "user", "lost"), (205, 0, "user", "gone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chars", F.lit(1))
    convs = trie.conversations(df)
    assert {r.conv_id: len(r.turns) for r in convs.collect()} == {100: 3, 101: 3, 205: 1}
    got = {(r.depth, r.n_convs) for r in trie.trie(convs).collect()}
    assert got == {(0, 3), (1, 2), (2, 2), (3, 2), (1, 1)}
    again = trie.rebuilt(convs, F.col("conv_id") - F.col("conv_id") % 100, F.lit(2), most=5)
    assert {r.conv_id: len(r.turns) for r in again.collect()} == {100: 3, 101: 3, 205: 0}  # conversation 200 is absent
    assert trie.trie(convs.limit(0)).count() == 0
