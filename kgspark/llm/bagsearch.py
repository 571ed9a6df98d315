"""Ranked lexical search by bag deduplication: documents that score alike for every item are scored once.

Documents are restricted to the vocabulary of the items: a document's bag is its sorted (term code, tf). Its length enters the score only
by m, a whole number that many lengths share. So a document is its class (bag, m): classes are shuffled by a hash and
compared whole, scored once each against all items by numpy, and expanded to their members, by ascending doc_id, only where they win.

A class beyond an item's `top` best, by score and then by least doc_id, can't hold one of its `top` documents: each better class brings
one of its own. So each task keeps that many classes an item, and only winning classes are expanded, each to `top` members at most.

Items are cut into their distinct terms in tasks and taken in blocks of about `BLOCK_TERMS` terms, whose vocabulary is broadcast; there is a
pass over the texts for each block, so any number of items does. No pairs of documents and items are ever made as rows.

Scores are whole numbers: `w * ((1000000000 * tf) div (1000 * tf + 12 * m))` summed over an item's terms, repeats included.

Defined cases: null texts have no terms; a document or an item without terms is found by nothing, but rows without terms count in
neither N nor L; a null doc_id ranks after all others of its score; repeated documents are ranked each; repeated and null item_ids
are an item each; without documents that hold terms there are no rows; very long texts count whole; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import chunks, forget, words_of, written

TOP, BLOCK_TERMS = 20, 200_000
CELLS, POSTINGS = 4_000_000, 4_000_000  # of a task's table of scores, and terms met at once
LAST = (1 << 63) - 1


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms, counts) of items (item_id, text) that hold terms; `item` numbers the rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bags = [Counter(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[t.decode("utf-8", "surrogatepass") for t in b] for b in bags], pa.list_(pa.string())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int64()))], ["item_id", "terms", "counts"])

    got = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<string>, counts array<long>")
    return written(got.where("size(terms) > 0").withColumn("item", F.monotonically_increasing_id()), "bagsearch-items")


def bags(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, bag): terms of the whole text with repeats, and its vocabulary terms as codes and then counts of 32 bits, by code."""
    held = docs.sparkSession.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codes = held.value
        for batch in batches:
            texts = batch.column(1)
            for at in chunks(list(range(batch.num_rows)), lambda i: texts[i].as_buffer().size + 50, 4_000_000):
                part, sizes, out = batch.slice(at[0], len(at)), [], []
                for t in part.column(1).to_pylist():
                    words = words_of(t)
                    c, n = np.unique(np.fromiter((codes[w] for w in words if w in codes), np.uint32), return_counts=True)
                    sizes.append(len(words))
                    out.append(c.astype("<u4").tobytes() + n.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "bag"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n long, bag binary"), "bagsearch-bags")


def _frequencies(held: DataFrame, size: int) -> dict[int, int]:
    """How many documents hold each term code; a row a task and code before the sum."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        df = np.zeros(size, np.int64)
        for batch in batches:
            every = [np.frombuffer(b, "<u4", len(b) // 8) for b in batch.column(0).to_pylist()]
            df += np.bincount(np.concatenate(every), minlength=size) if every else 0
        codes = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(df[codes])], ["code", "df"])

    rows = held.select("bag").mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).collect()  # the block's vocabulary at most
    return {r.code: r.df for r in rows}


def _scored(classes: DataFrame, weights: list[int], items: list[tuple[int, list[int], list[int]]], top: int) -> DataFrame:
    """(item, score, first, h, m, bag): each task's `top` best of classes (h, m, bag, first) for each of items (item, codes, counts)."""
    held = classes.sparkSession.sparkContext.broadcast((weights, items))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weight, own = np.array(held.value[0], np.int64), held.value[1]
        n_items = len(own)
        codes = np.concatenate([np.asarray(c, np.int64) for _, c, _ in own])
        order = np.argsort(codes, kind="stable")
        whose = np.repeat(np.arange(n_items), [len(c) for _, c, _ in own])[order]
        times = np.concatenate([np.asarray(q, np.int64) for _, _, q in own])[order]
        degree = np.bincount(codes, minlength=len(weight))
        begin = np.cumsum(degree) - degree
        best = None  # columns item, score, first, and the rows' (h, m, bag)

        def kept(item, score, first, rows):  # noqa: ANN001, ANN202
            order = np.lexsort((first, -score, item))
            item, score, first = item[order], score[order], first[order]
            start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
            rank = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
            keep = rank < top
            return item[keep], score[keep], first[keep], rows[order[keep]]

        for batch in batches:
            every = batch.column(2).to_pylist()
            for at in chunks(list(range(batch.num_rows)), lambda i: max(n_items, 16 * len(every[i])), CELLS):
                data = [np.frombuffer(every[i], "<u4") for i in at]
                n = np.array([len(x) // 2 for x in data])
                code = np.concatenate([x[: len(x) // 2] for x in data]).astype(np.int64)
                tf = np.concatenate([x[len(x) // 2 :] for x in data]).astype(np.int64)
                m = batch.column(1).slice(at[0], len(at)).to_numpy()
                row = np.repeat(np.arange(len(at)), n)
                impact = weight[code] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
                score = np.zeros(len(at) * n_items, np.int64)
                deg = degree[code]
                ends = np.cumsum(deg)
                lo = 0
                while lo < len(code):  # POSTINGS at once, or one term's
                    done = ends[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(ends, done + POSTINGS, side="right")))
                    d = deg[lo:hi]
                    where = np.repeat(begin[code[lo:hi]] - (ends[lo:hi] - d - done), d) + np.arange(int(d.sum()))
                    np.add.at(score, np.repeat(row[lo:hi], d) * n_items + whose[where], np.repeat(impact[lo:hi], d) * times[where])
                    lo = hi
                score = score.reshape(len(at), n_items)
                least = np.partition(score, len(at) - top, axis=0)[len(at) - top] if len(at) > top else np.zeros(n_items, np.int64)
                if best is not None:  # a class below an item's present last can't enter
                    full = np.bincount(best[0], minlength=n_items) >= top
                    low = np.full(n_items, LAST)
                    np.minimum.at(low, best[0], best[1])
                    least = np.maximum(least, np.where(full, low, 0))
                r, c = np.nonzero(score >= np.maximum(least, 1))
                if not len(r):
                    continue
                first = batch.column(3).slice(at[0], len(at)).to_numpy()[r]
                rows = np.empty(len(r), object)
                h, mm = batch.column(0).slice(at[0], len(at)).to_pylist(), m.tolist()
                rows[:] = [(h[i], mm[i], every[at[0] + i]) for i in r.tolist()]
                new = (c, score[r, c], first, rows)
                best = kept(*(new if best is None else [np.concatenate(x) for x in zip(best, new, strict=True)]))
        if best is not None:
            item, score, first, rows = best
            cols = [pa.array([own[i][0] for i in item.tolist()]), pa.array(score), pa.array(first), *(pa.array(x, t) for x, t in zip(zip(*rows.tolist(), strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True))]
            for i in range(0, len(item), 5000):
                yield pa.RecordBatch.from_arrays([c.slice(i, 5000) for c in cols], ["item", "score", "first", "h", "m", "bag"])

    return classes.select("h", "m", "bag", "first").mapInArrow(run, "item long, score long, first long, h long, m long, bag binary")


def _block(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """(item, item_id, rank, doc_id, score) of one block of items, whose vocabulary goes to every task."""
    rows = items.select("item", "item_id", "terms", "counts").collect()  # about BLOCK_TERMS terms
    vocabulary = sorted({t for r in rows for t in r.terms})
    code = {t: i for i, t in enumerate(vocabulary)}
    own = [(r.item, [code[t] for t in r.terms], r.counts) for r in rows]
    held = bags(docs, vocabulary)
    n_docs, total = held.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(held, len(vocabulary))
    weights = [floor(1000 * log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]
    m = F.lit(75) + F.expr(f"(cast(n as decimal(18, 0)) * cast({25 * n_docs} as decimal(19, 0))) div cast({max(total, 1)} as decimal(19, 0))")
    found = held.where(F.octet_length("bag") > 0).select("doc_id", "bag", m.cast("long").alias("m")).withColumn("h", F.xxhash64("bag", "m"))
    classes = found.groupBy("h", "m", "bag").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"))
    key = ["h", "m", "bag"]
    best = W.partitionBy("item").orderBy(F.desc("score"), "first", *key)
    won = written(_scored(classes, weights, own, top).withColumn("k", F.row_number().over(best)).where(F.col("k") <= top).drop("k", "first"), "bagsearch-won")
    hashes = F.broadcast(won.select("h").distinct())  # at most `top` of each of the block's items
    members = found.join(hashes, "h", "left_semi").withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("k") <= top)
    members = written(members.select(*key, "doc_id"), "bagsearch-members")
    forget(held)
    place = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = won.join(members, key).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item", "item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents (doc_id, text) of each of items (item_id, text), from rank 1."""
    terms = item_terms(items)
    n = max(1, -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    out = None
    for k in range(n):
        got = _block(docs, terms.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k), top)
        out = got if out is None else out.unionByName(got)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def brute_force(docs: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]], top: int = TOP) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every item; for tests."""
    have = [(d, Counter(words_of(t)), len(words_of(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for *_, n in have), sum(n for *_, n in have)
    df = Counter(w for _, b, _ in have for w in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, n in have:
            if n:
                m = 75 + 25 * n * n_docs // total
                s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 12 * m)) for w in words_of(text) if w in b)
                scored.append((-s, LAST if d is None else d, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:top])]
    return out
