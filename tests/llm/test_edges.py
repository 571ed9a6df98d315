"""Defined cases of every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns; each against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from kgspark.llm import chat, decontaminate, fingerprints, licenses, nearjoin, sharding, suffixtree, toxicity
from kgspark.llm.common import words_of

LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(8_000))
TEXTS = [
    (1, "", "en", "a"), (2, None, None, None), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (3, "another text of the same number", "en", "a"), (4, LONG, "de", "a"), (5, LONG + " more", "de", "b"),
    (None, "null id text here now", "en", "b"), (None, None, "en", "b"), (6, "Under CC BY, the GPL v2 or General Public License. All rights reserved.\n\n all RIGHTS reserved cc by", "en", "b"), (7, "Été \\ ### </turn>", "fr", "c"),
]
EXTRA = ["row", "score", "my col", "a-b", "n_words", "text_", "start", "order"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")], T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])
    return spark.createDataFrame([(*r, len(r[1] or ""), *(["x"] * len(EXTRA))) for r in TEXTS], schema).cache()


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_chat_digests(spark):
    long = "abc </turn> " * 5_000
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "assistant", "x"), (1, 1 << 50, "assistant", long), (1, -1, "user", None), (1, None, "system", "before all"), (2, 0, None, None), (None, 3, "assistant", ""), (3, 0, "a:b", "\\### a: </turn>\n")]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t} \\ ### </turn>") for t in range(40)]
    turns = spark.createDataFrame([(*r, "e", "k") for r in rows], "conv_id long, turn long, role string, text string, kind string, seq string")
    log = chat.events_of(turns, delta=1_000)
    assert {"message", "delta", "edit", "regenerate"} == {r.kind for r in log.select("kind").distinct().collect()}
    assert log.where("msg_id like '%/reply'").count() > 0
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(log)).collect()}
    assert set(got) == set(by)
    for c, ts in by.items():
        loss = "".join(t for role, t in ts if role == "assistant")
        want = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert chat.digests(chat.formatted(chat.events_of(turns.limit(0)))).count() == 0


def sketch(text, fraction=fingerprints.FRACTION):
    """The sketch of a text by Spark's own hash of each shingle, gathered in Python."""
    w = [x.decode() for x in words_of(text)]
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_sketches_equal_brute_force(spark, docs):
    texts = sorted({(t or "") for _, t, *_ in TEXTS})
    shingles = sorted({s for t in texts for s in sketch(t)})
    hashed = spark.createDataFrame([(i, list(s)) for i, s in enumerate(shingles)], "i long, s array<string>")
    hashes = hashed.select("i", F.shiftrightunsigned(F.xxhash64(*[F.xxhash64(F.get("s", F.lit(k))) for k in range(5)]), 16).alias("h"))
    # a word that isn't there hashes as null, as in the operator
    null_safe = hashed.select("i", F.shiftrightunsigned(F.xxhash64(*[F.when(F.size("s") > k, F.xxhash64(F.get("s", F.lit(k)))) for k in range(5)]), 16).alias("h"))
    h = {shingles[r.i]: r.h for r in null_safe.collect()}
    assert hashes.count() == len(h)
    limit = int(fingerprints.FRACTION * (1 << 48))

    def kept(values):
        low = sorted(v for v in set(values) if v < limit)
        return low or sorted(values)[:1]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.s for r in fingerprints.with_sketch(df, "t", "s").collect()}
    assert got == {i: kept([h[s] for s in sketch(t)]) for i, t in enumerate(texts)}
    pairs = fingerprints.with_sketch(df, "t", "s").select("i", "s")
    both = pairs.crossJoin(pairs.select(F.col("i").alias("j"), F.col("s").alias("z")))
    for r in both.select("i", "j", fingerprints.merged("s", "z").alias("m"), fingerprints.likeness("s", "z").alias("l")).collect():
        own, other = set(got[r.i]), set(got[r.j])
        assert r.m == kept([h[s] for s in sketch(texts[r.i]) + sketch(texts[r.j])])
        assert r.l == (len(own & other) / len(own | other) if own | other else 1.0)


def test_fingerprints_order_ties_and_nulls(docs):
    got = fingerprints.edited_fingerprints(docs)
    order = sorted([(r[0] is None, -(r[0] or 0), r[1] or "") for r in TEXTS])
    texts = [t for *_, t in order]
    want = []
    for k, (none, doc, t) in enumerate(order):
        nxt, cut = texts[(k + 1) % len(texts)], len(t) // 3
        want.append((None if none else -doc, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert tuples(got, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)


def test_lm_base_columns_equal_brute_force(spark, docs):
    held = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    got = tuples(suffixtree.scores(docs, held).withColumn("base_score", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    rows = [(d, d is not None and d % 2 == 0, [*suffixtree.tokens_of((t or "").encode()), suffixtree.END]) for d, t, *_ in TEXTS]
    seen = Counter(w for _, out, ws in rows if not out for w in ws)
    n, v = sum(seen.values()), len(seen)
    want = [(d, out, len(ws), sum(seen[w] > 0 for w in ws), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, out, ws in rows]
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=repr)]
    assert sum(g[5] for g in got) == pytest.approx(sum(w[5] for w in want), rel=1e-9)


def test_lm_held_out_texts_are_better_than_by_words_alone(spark):
    """The tree's scores of held-out texts beat the word base in sum and for most texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = suffixtree.scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).where("held_out").select("score", "base_score").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > 0.8 * len(got)


def test_license_base_columns_equal_brute_force(docs):
    phrases = [(p.split(" "), label) for p, label in licenses.PHRASES]
    want = []
    for d, t, *_ in TEXTS:
        w = [x.decode() for x in words_of(t)]
        at = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        want.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert tuples(licenses.license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)


def test_shards_hold_each_source_in_proportion(spark):
    rows = [(i, f"text {i % 7}", "big" if i % 3 else f"s{i % 5}") for i in range(600)] + [(None, None, None)] * 9
    got = sharding.stratified_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8).collect()
    sizes, per = Counter(r.stratum for r in got), Counter((r.shard, r.stratum) for r in got)
    assert len(got) == len(rows) and max(Counter(r.shard for r in got).values()) - min(Counter(r.shard for r in got).values()) <= 1
    assert all(abs(per[k, s] - n / 8) <= 2 for s, n in sizes.items() for k in range(8))
    known = lambda d: -1 if d is None else d
    assert sorted((known(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((known(d), len(t or "") + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)


def test_shards_equal_a_plain_sort_by_fractional_rank(spark):
    rows = [(i, f"text {i % 11}", "big" if i % 3 else f"s{i % 4}") for i in range(300)] + [(None, None, None)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = docs.selectExpr("doc_id", "text", "source", "xxhash64(17, doc_id, crc32(cast(coalesce(text, '') as binary)), source) as h", "pmod(xxhash64(18, source), 1073741824) / 1073741824d as start").collect()
    order: dict = {}
    for r in hashes:
        order.setdefault(r.source, []).append(r)
    placed = []
    for source, own in order.items():
        blocks = sorted(own, key=lambda r: ((r.h % 2**64) >> 56, r.h))  # blocks of hashes, each by signed hash
        placed += [((k + r.start) / len(own), source is not None, source or "", r.h, -1 if r.doc_id is None else r.doc_id) for k, r in enumerate(blocks)]
    placed.sort()
    n, want = len(placed), []
    for k, x in enumerate(placed):
        shard = k * 7 // n
        want.append((shard, k - -(-shard * n // 7), x[4]))
    got = sorted((r.shard, r.slot, -1 if r.doc_id is None else r.doc_id) for r in sharding.stratified_shards(docs, 7).collect())
    assert got == want


def test_toxicity_scores_equal_a_plain_convolution():
    import numpy as np

    rng = np.random.default_rng(2)
    texts = ["", "one", "one two three four two one", "a b c " * 50, "ünï çödé two", "b"]
    words = [[zlib.crc32(w) % (toxicity.BUCKETS - 1) + 1 for w in words_of(t)] + [0] * 3 for t in texts]
    model = toxicity.fit([np.array(w, np.int32) for w in words], [0, 1, 0, 1, 0, 1], epochs=2, least=1)
    got = model.scores(*toxicity.hashed(texts, {}))
    for text, score in zip(words, got, strict=True):
        best = []
        for w, table, bias in zip(toxicity.WIDTHS, model.tables, model.bias, strict=True):
            windows = [sum(table[k][text[i + k]] for k in range(w)) for i in range(len(text) - w + 1)]
            best += [max(0.0, max(float(x[f]) for x in windows) + float(bias[f])) for f in range(toxicity.FILTERS)]
        assert math.log(score / (1 - score)) == pytest.approx(sum(b * float(o) for b, o in zip(best, model.out, strict=True)) + model.out_bias, abs=0.02)
        assert model.scores(*toxicity.hashed([texts[words.index(text)]], {}))[0] == pytest.approx(score, rel=1e-5)  # whatever stands beside it


def test_sharding_digests(docs):
    got = tuples(sharding.stratified_shards(docs, 3), "doc_id", "size", "text_crc32")
    assert got == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in TEXTS), key=repr)


@pytest.mark.parametrize(("block", "group"), [(decontaminate.BLOCK_BYTES, decontaminate.GROUP_BYTES), (60, 200), (60, 60)])
def test_decontamination_in_blocks_and_passes(spark, docs, monkeypatch, block, group):
    items = [(1, " ".join(LONG.split()[50:70])), (2, "one TWO"), (2, "one TWO"), (3, None), (4, "not there at all"), (5, LONG[:30_000]), (None, "null id text"), (6, "été"), (7, "general public license all rights reserved all rights reserved cc by")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PIECE", 2_000)
    few = [(i, t) for i, t in items if i != 5] if block == 60 else items
    bench = spark.createDataFrame(few, "item_id long, text string")
    got = decontaminate.scan(docs, bench, ["doc_id", "text"], block_bytes=block, group_bytes=group).collect()
    assert len(got) == len(TEXTS)
    plain = [(None if i is None else str(i), t) for i, t in few if i != 5]
    for r in got:
        if len(r.row.text or "") < 5_000:
            n, hit, found = decontaminate.brute_force(r.row.text, plain)
            assert (r.n_words, r.n_hit, r["items"]) == (n, hit, sorted(x for x in found if x))
            inside = sum(len(words_of((r.row.text or "")[s.start : s.stop])) for s in r.spans)
            assert inside == hit
        else:
            assert "1" in r["items"] and (block == 60 or r.n_hit >= 7_000)
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert decontaminate.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_long_items_are_cut_without_losing_windows(spark):
    words = [f"w{i}" for i in range(97)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "a b c")], "item_id long, text string")
    got = decontaminate.pieces(bench, 10, piece=20).collect()
    wins = {tuple(p.norm.split()[i : i + 10]) for p in got if p.item == "1" for i in range(len(p.norm.split()) - 9)}
    assert wins == {tuple(words[i : i + 10]) for i in range(88)} and all(len(p.norm.split()) <= 29 for p in got)


def test_near_join_keeps_nulls_ties_and_repeats(docs):
    rows = [(i, t or "") for i, (_, t, *_) in enumerate(TEXTS)]
    links = nearjoin.brute_force(dict(rows))
    got = nearjoin.classes(docs).collect()
    assert sorted((r.doc_id or -1, r.n_links) for r in got) == sorted(((d or -1), len(links[i])) for i, (d, *_) in enumerate(TEXTS))
    kept = nearjoin.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len({min({i} | links[i]) for i in links})


def test_near_join_recall_over_queries(spark):
    """Every 50th row against all rows, with buckets small enough to be split: recall of links by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := words_of(t))}
    want = {}
    for q in (d for d in sets if d % 50 == 0):
        want[q] = sum(1 for d, s in sets.items() if d != q and (b := len(s & sets[q])) >= 0.8 * (len(s) + len(sets[q]) - b))
    rows = nearjoin.signed(docs)
    reps, found = nearjoin.links(rows, limit=8)
    n = found.groupBy("skey").agg(F.sum("weighted").alias("w"))
    got = {r.doc_id: r.n for r in rows.join(reps, "skey").join(n, "skey", "left").select("doc_id", (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n")).collect()}
    assert sum(want.values()) > 0 and sum(got[q] for q in want) >= 0.99 * sum(want.values())
    assert all(got[q] <= want[q] for q in want)


def test_toxicity_cases(spark, docs):
    marks = spark.createDataFrame([(1, 0, "e"), (3, 1, "e"), (3, 0, "e"), (4, 0, "e"), (None, 1, "e"), (6, None, "e"), (99, 1, "e")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, marks, F.coalesce(F.col("doc_id") == 7, F.lit(False))).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.threshold == 0.5 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {7}
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # no words, either way
    again = toxicity.toxicity(docs, marks, F.coalesce(F.col("doc_id") == 7, F.lit(False))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert toxicity.toxicity(docs.limit(0), marks, F.lit(False)).count() == 0
    kept = toxicity.clean(docs, marks.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_toxicity_thresholds_come_from_counts():
    assert toxicity.threshold([5, 0, 0, 0], [0, 0, 0, 5]) == 0.5 and toxicity.threshold([1, 1], [0, 0]) == 0.5
    assert toxicity.threshold([9, 1, 0, 0], [0, 9, 9, 9]) == 0.25


def test_pipeline_runs_on_whole_tables(spark, tmp_path, docs):
    """run() on a small table equals its stages in turn; an empty table and extra columns pass."""
    sf = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "in")).collect()
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path / "in"))
        assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in rows if r.start == 0) == sorted(r.doc_id or -1 for r in left.select("doc_id").collect())
    for doc in {(r.doc_id, r.doc_tokens) for r in rows if r.doc_id is not None}:  # a doc_id that repeats has texts of different sizes here
        at = 0
        for r in sorted((r for r in rows if (r.doc_id, r.doc_tokens) == doc), key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == r.doc_tokens
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
