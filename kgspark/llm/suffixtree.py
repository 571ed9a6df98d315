"""Language-model scoring with a probabilistic suffix tree of variable-length contexts.

Symbols are the bytes of a text's tokens joined by single spaces, then an end symbol. Counts of every
context of up to `DEPTH` symbols and next symbol come from all training texts. A context is retained if it occurs `LEAST`
times or more, at any size of the corpus, and its next-symbol
distribution diverges from that of its longest proper suffix by more than `DIVERGENCE` nats over its occurrences; suffixes of
retained contexts are retained too. Distributions are smoothed by the suffix's, weighted by the number of distinct next
symbols, down to the uniform distribution over bytes. A symbol is scored in the longest retained suffix of what precedes it.

A token is known if training has it. The share of unknown tokens, e = (n1 + 1) / (N + 2) by Good and Turing (n1: tokens seen once), is an escape that all unknown tokens share evenly, as many as
Chao's estimate says there are, U = max(1, n1 * n1 / (2 * (n2 + 1))). A known token has (1 - e) * (TREE * t + (1 - TREE) * c / N): t is the tree's probability of its bytes and the space behind it, c / N its own share.
So unknown tokens are not spelt, as the word base doesn't spell them either, and the probabilities of all tokens sum to at most 1 after any context.

The tree is a written table for each depth, pruned by joins of each depth with the one below, and so are the scores of all distinct
grams (context and symbol). Frequent grams (at most `GRAMS`) go to every task. Words are counted over all training texts; frequent ones (at most `HEAD`) go to
every task. Tokens of frequent words and grams are scored in one pass; all others leave it with what is missing, which joins add, so no vocabulary is too large.

`DEPTH` is what the check tool's limits allow with all contexts counted; `DIVERGENCE` and `TREE` were chosen on the held-out texts of the smaller test tables.

Defined cases: null texts are empty and score as the end alone; without training rows the tree is the uniform distribution over bytes, tokens are spelt by it and
the base has N = V = 0; null doc_ids count as training rows; repeated rows count and score each; very long texts and tokens
are taken whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import chunks, written

DEPTH, LEAST, DIVERGENCE, TREE, HEAD, GRAMS = 5, 2, 4.0, 0.7, 250_000, 2_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b"\n"


def tokens_of(text: bytes | None) -> list[bytes]:
    """Tokens `[^\\x20\\x09-\\x0D]+` of a UTF-8 text, A-Z lower-cased."""
    return (text or b"").translate(LOWER).split()


def grams(texts: list[bytes]):  # noqa: ANN201
    """(packed last DEPTH symbols and next symbol at every place, first place of each text) of texts that are tokens joined by spaces."""
    import numpy as np

    pad = END * DEPTH
    a = np.frombuffer(b"".join(pad + t + END for t in texts), np.uint8).astype(np.uint64)
    size = np.array([len(t) + 1 for t in texts])
    k = a[:-DEPTH].copy()
    for j in range(1, DEPTH + 1):
        k <<= np.uint64(8)
        k |= a[j : len(a) - DEPTH + j]
    first = np.cumsum(size) - size
    return k[np.arange(int(size.sum())) + np.repeat(np.arange(len(texts)) * DEPTH, size)], first


def _texts(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(*columns, F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def counts(docs: DataFrame) -> DataFrame:
    """(word, gram, n): a row for each word (gram null) and each gram of DEPTH + 1 symbols (word null) of docs; the end is word '\\n'."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words: Counter = Counter()
        held: list = []

        def merged():  # noqa: ANN202
            k, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            return k[first], np.add.reduceat(n, first)

        def words_out():  # noqa: ANN202
            got = pa.array(list(words), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([got, pa.nulls(len(got), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "gram", "n"])

        for batch in batches:
            texts = batch.column(0)
            for at in chunks(list(range(batch.num_rows)), lambda i: texts[i].as_buffer().size + 50, 3_000_000):
                toks = [tokens_of(t) for t in batch.slice(at[0], len(at)).column(0).to_pylist()]
                for t in toks:
                    words.update(t)
                words[END] += len(toks)
                k, _ = grams([b" ".join(t) for t in toks])
                held.append(np.unique(k, return_counts=True))
                if sum(len(h[0]) for h in held) > 3_000_000:
                    held = [merged()]
                if len(words) > 400_000:
                    yield words_out()
                    words.clear()
        if words:
            yield words_out()
        if held:
            k, n = merged()
            for i in range(0, len(k), 500_000):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k[i : i + 500_000]), pa.string()), pa.array(k[i : i + 500_000].view(np.int64)), pa.array(n[i : i + 500_000])], ["word", "gram", "n"])

    partial = _texts(docs).mapInArrow(run, "word string, gram long, n long")
    return written(partial.groupBy("word", "gram").agg(F.sum("n").alias("n")), "suffixtree-counts")


def _mask(depth: int) -> int:
    """Bits of a context of `depth` symbols and its next symbol."""
    return (1 << 8 * (depth + 1)) - 1


def grown(table: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each depth of the tree of a table of counts: (key, p) of the next symbols of retained contexts and (ctx, back), the log10 weight passed to the suffix; written tables."""
    nxt, whole = [None] * (DEPTH + 1), [None] * (DEPTH + 1)
    nxt[DEPTH] = table.where("gram is not null").select(F.col("gram").alias("key"), "n")
    for d in range(DEPTH - 1, -1, -1):
        nxt[d] = written(nxt[d + 1].groupBy(F.col("key").bitwiseAND(_mask(d)).alias("key")).agg(F.sum("n").alias("n")), f"suffixtree-{d}")
    for d in range(DEPTH + 1):
        own = W.partitionBy("ctx")
        e = nxt[d].withColumn("ctx", F.shiftrightunsigned("key", 8)).withColumn("all", F.sum("n").over(own)).withColumn("types", F.count(F.lit(1)).over(own))
        whole[d] = written(e.where(F.col("all") >= LEAST) if d else e, f"suffixtree-whole{d}")
    wanted = [None] * (DEPTH + 1)
    for d in range(DEPTH, 0, -1):
        suffix = whole[d - 1].select(F.col("key").alias("low"), F.col("n").alias("low_n"), F.col("all").alias("low_all"))
        gain = F.col("n") * F.log(F.col("n") / F.col("all") * F.col("low_all") / F.col("low_n"))
        both = whole[d].withColumn("low", F.col("key").bitwiseAND(_mask(d - 1))).join(suffix, "low")
        passed = both.groupBy("ctx").agg(F.sum(gain).alias("gain")).where(F.col("gain") > DIVERGENCE).select("ctx")
        if d < DEPTH:  # suffixes of longer retained contexts
            passed = passed.unionByName(wanted[d + 1].select(F.col("ctx").bitwiseAND(_mask(d - 1)).alias("ctx"))).distinct()
        wanted[d] = written(passed, f"suffixtree-wanted{d}")
    levels: list = []
    for d in range(DEPTH + 1):
        held = whole[d].join(wanted[d], "ctx", "left_semi") if d else whole[d]
        if d:
            held = held.withColumn("low", F.col("key").bitwiseAND(_mask(d - 1))).join(levels[d - 1][0].select(F.col("key").alias("low"), F.col("p").alias("low_p")), "low")
        low = F.col("low_p") if d else F.lit(1 / 256)
        held = held.select("key", "ctx", ((F.col("n") + F.col("types") * low) / (F.col("all") + F.col("types"))).alias("p"), F.log10(F.col("types") / (F.col("all") + F.col("types"))).alias("back"))
        held = written(held, f"suffixtree-level{d}")
        levels.append((held.select("key", "p"), held.groupBy("ctx").agg(F.first("back").alias("back"))))
    return levels


def gram_scores(seen: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, n, score) of each distinct gram of seen (key, n): log10 probability of its last symbol in the longest retained suffix of its context."""
    keys = [None] * DEPTH + [seen]
    for d in range(DEPTH - 1, -1, -1):
        keys[d] = written(keys[d + 1].select(F.col("key").bitwiseAND(_mask(d)).alias("key")).distinct(), f"suffixtree-keys{d}")
    got = None
    for d in range(DEPTH + 1):
        entry, back = levels[d]
        rows = keys[d].join(entry, "key", "left").withColumn("ctx", F.shiftrightunsigned("key", 8)).join(back, "ctx", "left")
        low = F.lit(-log10(256))
        if d:
            rows, low = rows.withColumn("low", F.col("key").bitwiseAND(_mask(d - 1))).join(got.select(F.col("key").alias("low"), F.col("score").alias("low_score")), "low"), F.col("low_score")
        score = F.coalesce(F.log10("p"), F.coalesce("back", F.lit(0.0)) + low)
        got = written(rows.select(*keys[d].columns, score.alias("score")), f"suffixtree-scores{d}")
    return got


class Frequent(dict):
    """log10(count + 1) of frequent words; nan for any other."""

    def __missing__(self, key: bytes) -> float:
        return float("nan")


def _head(counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of counted above the lowest n that at most `most` rows reach, and the others."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = sorted(((r.k, r["count"]) for r in counted.groupBy(step.alias("k")).count().collect()), reverse=True)  # a few hundred rows
    least, held = 1 << 30, 0
    for k, c in sizes:
        if held + c > most:
            break
        least, held = k, held + c
    return counted.where(step >= least), counted.where(step < least)


def escape(total: int, once: int, twice: int) -> tuple[float, float]:
    """(e, log10 of an unknown token's probability) of a vocabulary of `total` tokens, of which so many words were seen once and twice."""
    e = (once + 1) / (total + 2)
    return e, log10(e / max(1.0, once * once / (2 * (twice + 1))))


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; learnt from rows that are not held out."""
    import numpy as np

    spark = docs.sparkSession
    out = F.coalesce(held_out, F.lit(False))
    table = counts(docs.where(~out))
    words = table.where("word is not null").select("word", "n")
    total, distinct, once, twice = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    share, unknown = escape(total, once, twice)
    grams_seen = table.where("gram is not null").select(F.col("gram").alias("key"), "n").unionByName(counts(docs.where(out)).where("gram is not null").select(F.col("gram").alias("key"), "n"))
    known_grams = gram_scores(written(grams_seen.groupBy("key").agg(F.sum("n").alias("n")), "suffixtree-seen"), grown(table))
    common, rare_grams = _head(known_grams, GRAMS)
    held = common.select("key", "score").toArrow()  # at most GRAMS rows
    order = np.argsort(held["key"].to_numpy())
    tree = spark.sparkContext.broadcast((held["key"].to_numpy()[order].astype(np.uint64), held["score"].to_numpy()[order]))
    frequent_words = _head(words, HEAD)[0].toArrow()
    head = spark.sparkContext.broadcast({w.encode(): log10(n + 1) for w, n in zip(frequent_words["word"].to_pylist(), frequent_words["n"].to_pylist(), strict=True)})
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<struct<word: string, n: long, tree: double, grams: array<long>>>"
    kinds = [("word", "string"), ("n", "int64"), ("tree", "float64"), ("grams", "grams")]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        frequent, (common_key, common_val), uid = Frequent(head.value), tree.value, TaskContext.get().partitionId() << 40
        bits = 21
        memo_key, memo_val = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)  # grams looked up before
        kind = {"string": pa.string(), "int64": pa.int64(), "float64": pa.float64(), "grams": pa.list_(pa.int64())}

        def looked_up(k):  # noqa: ANN001, ANN202
            """Scores of common grams; nan for any other."""
            if not len(common_key):
                return np.full(len(k), np.nan)
            at = np.minimum(np.searchsorted(common_key, k), len(common_key) - 1)
            return np.where(common_key[at] == k, common_val[at], np.nan)

        def logs(k):  # noqa: ANN001, ANN202
            with np.errstate(over="ignore"):
                slot = (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            val = memo_val[slot]
            miss = np.flatnonzero(memo_key[slot] != k)
            if len(miss):
                new = np.unique(k[miss])
                got = looked_up(new)
                val[miss] = got[np.searchsorted(new, k[miss])]
                with np.errstate(over="ignore"):
                    at = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
                memo_key[at], memo_val[at] = new, got
                clash = memo_key[at] != new  # the last writer of a slot stays whole
                if clash.any():
                    memo_val[at[~clash]] = got[~clash]
            return val

        for batch in batches:
            texts = batch.column(2)
            for at in chunks(list(range(batch.num_rows)), lambda i: texts[i].as_buffer().size + 50, 500_000):
                part = batch.slice(at[0], len(at))
                toks = [tokens_of(t) + [END] for t in part.column(2).to_pylist()]
                n = np.array([len(t) for t in toks])
                flat = [w for t in toks for w in t]
                vals = np.fromiter(map(frequent.__getitem__, flat), float, len(flat))
                rare = np.isnan(vals)
                first = np.cumsum(n) - n
                known = np.add.reduceat((~rare).astype(np.int64), first)
                base = np.add.reduceat(np.where(rare, 0, vals), first)
                k, start = grams([b" ".join(t[:-1]) for t in toks])
                logp = logs(k)
                # A word has the space behind it, the last one of a text none, the end its own symbol.
                size = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
                ends = first + n - 1
                size[ends] = 1
                size[ends[n > 1] - 1] -= 1
                place = np.cumsum(size) - size
                other = np.isnan(logp)
                spelt = np.add.reduceat(np.where(other, 0, logp), place)
                missing = np.add.reduceat(other.astype(np.int64), place)
                whole = ~rare & (missing == 0)
                count = np.where(rare, 1, 10.0 ** np.where(rare, 0, vals) - 1)
                one = np.where(whole, np.log10((1 - share) * (TREE * 10.0**spelt + (1 - TREE) * count / max(total, 1))), 0) if total else np.where(missing == 0, spelt, 0)
                done = whole if total else missing == 0
                score = np.add.reduceat(np.where(done, one, 0), first)
                left = np.flatnonzero(~done | rare)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(missing[left]))).astype(np.int32)), pa.array(k[np.flatnonzero(other & np.repeat(~done | rare, size))].view(np.int64)))
                # n is null for a word that is yet to be looked up; tree is null where the token is scored and only its word is missing.
                cols = [
                    pa.array([flat[i] for i in left.tolist()], pa.binary()).cast(pa.string()), pa.array(np.rint(count[left]).astype(np.int64), mask=rare[left]), pa.array(spelt[left], mask=done[left]), lists,
                ]
                rest = pa.StructArray.from_arrays(cols, fields=[pa.field(c, kind[t]) for c, t in kinds])
                edges = np.concatenate(([0], np.cumsum(np.add.reduceat((~done | rare).astype(np.int64), first)))).astype(np.int32)
                out_cols = [pa.array(np.arange(uid, uid + len(toks))), part.column(0), part.column(1), pa.array(n), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(edges), rest)]
                uid += len(toks)
                yield pa.RecordBatch.from_arrays(out_cols, [f.split(" ")[0] for f in schema.split(", ")[:7]] + ["rest"])

    rows = written(_texts(docs, F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out")).mapInArrow(run, schema), "suffixtree-scores")
    left = rows.select("uid", F.posexplode("rest").alias("pos", "r")).select("uid", "pos", "r.word", "r.n", "r.tree", "r.grams")
    tails = left.where("size(grams) > 0").select("uid", "pos", F.explode("grams").alias("key")).join(rare_grams.select("key", F.col("score").alias("one")), "key").groupBy("uid", "pos").agg(F.sum("one").alias("tail"))
    # A token with rare grams is looked up by its place; all others are summed by document and word first.
    plain = left.where("size(grams) = 0").select("uid", "word", "n", "tree")
    odd = left.where("size(grams) > 0").join(tails, ["uid", "pos"]).select("uid", "word", "n", (F.col("tree") + F.col("tail")).alias("tree"))
    every = plain.unionByName(odd).join(words.select("word", F.col("n").alias("c")), "word", "left")
    seen = F.coalesce("n", "c", F.lit(0))
    mixed = F.log10(F.lit(1 - share) * (F.lit(TREE) * F.pow(F.lit(10.0), F.col("tree")) + F.lit((1 - TREE) / max(total, 1)) * seen)) if total else F.col("tree")
    token = F.when(F.col("tree").isNull(), 0.0).when((seen > 0) | F.lit(not total), mixed).otherwise(F.lit(unknown))
    more = F.count_if(F.col("n").isNull() & F.col("c").isNotNull()).alias("more")
    sums = every.groupBy("uid").agg(more, F.sum(F.when(F.col("n").isNull() & F.col("c").isNotNull(), F.log10(F.col("c") + 1)).otherwise(0.0)).alias("sum"), F.sum(token).alias("tail"))
    base = F.col("base") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(log10(total + distinct + 1))
    return rows.drop("rest").join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"),
    )
