"""Retrieval and matching over vectors, extraction with injected models, evaluation, threads and jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from kgspark.functions.text import json_fields, trim_answer
from kgspark.operators.ranges import at_rank, ranged
from kgspark.operators.vindex import usable
from kgspark.store import forget, stored


def apply_model(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """An injected model over batches of rows: iterator of pandas frames to iterator of pandas frames."""
    return df.mapInPandas(fn, schema)


def apply_json_model(df: DataFrame, fn: Callable[[Iterator], Iterator], key: str, schema: str) -> DataFrame:
    """An injected model that answers in JSON: fn takes batches of df to (key, json); the answer's fields come back as columns, null where the JSON is bad or no object."""
    kind = df.schema[key].dataType.simpleString()
    got = df.mapInPandas(fn, f"{key} {kind}, json string").withColumn("_j", json_fields(F.col("json"), schema))
    return got.select(key, "_j.*")


def in_blocks(rows: DataFrame, key: str, blocks: int, task: Callable[[list], DataFrame]) -> DataFrame:
    """The union of task(rows of a block) over blocks by a hash of key. One block at a time is on the driver: beyond one, each block's result is written before the next is read."""
    if blocks == 1:
        return task(rows.collect())
    dealt = stored(rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).repartitionByRange("_b").sortWithinPartitions("_b"), "blocks")
    out = None
    for b in range(blocks):
        got = stored(task(dealt.where(F.col("_b") == b).drop("_b").collect()), "block")
        out = got if out is None else out.unionByName(got)
    forget(dealt)
    return out


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, block_bytes: int = 16 << 20, rows_at_once: int = 4096, queries_at_once: int = 256) -> DataFrame:
    """(qid, id, distance, rank): the k nearest chunks (id, embedding) of each query (qid, vector) by cosine distance, ties (to 12 places) by id; exact.

    Queries go to every task in blocks of at most block_bytes. A task multiplies matrices, `queries_at_once` by `rows_at_once`, and keeps k chunks a query, so only those are shuffled and merged.
    Null, zero and broken vectors are left out, and those of another length than most queries.
    """
    usual = queries.where("vector is not null").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = usual.d if usual else 0
    queries, chunks = queries.where(usable(F.col("vector"), size)), chunks.where(usable(F.col("embedding"), size))
    blocks = max(1, -(-(queries.count() * max(1, size) * 8) // block_bytes))
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", chunks.schema["id"].dataType), T.StructField("distance", T.DoubleType())])

    def of_block(rows: list) -> DataFrame:
        import numpy as np

        held = chunks.sparkSession.sparkContext.broadcast(([r.qid for r in rows], np.array([r.vector for r in rows], np.float64)))  # block_bytes

        def nearest(batches: Iterator) -> Iterator:
            import pandas as pd

            unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)
            qids, q = held.value
            if not qids:
                return
            q, far, ids = unit(q), np.empty((len(q), 0)), None

            def best(d, i, n: int):  # noqa: ANN001, ANN202
                """The n nearest of each row; only those up to the n-th distance are sorted."""
                r, c = np.nonzero(d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n] + 1e-12)
                d, i = np.round(d[r, c], 12), i[r, c]
                order = np.lexsort((i, d, r))
                first = np.arange(len(r)) - np.searchsorted(r, r) < n  # r is sorted, and as it is in order
                return d[order][first].reshape(-1, n), i[order][first].reshape(-1, n)

            for pdf in batches:
                for at in range(0, len(pdf), rows_at_once):
                    part = pdf.iloc[at : at + rows_at_once]
                    own, v = part["id"].to_numpy(), unit(np.array(part["embedding"].tolist(), np.float64))
                    n = min(k, far.shape[1] + len(v))
                    new_far, new_ids = np.empty((len(q), n)), np.empty((len(q), n), own.dtype)
                    for x in range(0, len(q), queries_at_once):
                        to = slice(x, x + queries_at_once)
                        d = 1 - q[to] @ v.T
                        i = np.broadcast_to(own, d.shape)
                        if ids is not None:
                            d, i = np.concatenate([far[to], d], 1), np.concatenate([ids[to], i], 1)
                        new_far[to], new_ids[to] = best(d, i, n)
                    far, ids = new_far, new_ids
            for x in range(0, len(q) if ids is not None else 0, 8192):
                to = slice(x, x + 8192)
                yield pd.DataFrame({"qid": [y for y in qids[to] for _ in range(far.shape[1])], "id": ids[to].ravel(), "distance": far[to].ravel()})

        top = chunks.select("id", "embedding").mapInPandas(nearest, schema)
        return top.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("distance", "id"))).where(F.col("rank") <= k)

    return in_blocks(queries.select("qid", "vector"), "qid", blocks, of_block)


def embed(rows: DataFrame, text: str, embedder: Callable[[Column], Column], out: str = "embedding") -> DataFrame:
    """rows with the vectors of a text column by an injected embedder (an Arrow function of columns)."""
    return rows.withColumn(out, embedder(F.col(text)))


def token_overlap(query: Column, text: Column) -> Column:
    """A pair scorer: the share of the query's distinct words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda w: w != ""))
    return F.when(F.size(words(query)) == 0, 0.0).otherwise(F.size(F.array_intersect(words(query), words(text))) / F.size(words(query)))


def rerank(hits: DataFrame, score: Column | None, k: int) -> DataFrame:
    """Hits (qid, rank, ...) by score, ties in their former order; k stay. Without a scorer, for a question of one hit, and where a score is null, the former order holds."""
    if score is None:
        return hits.where(F.col("rank") <= k).withColumn("rerank_score", F.lit(None).cast("double"))
    own = W.partitionBy("qid")
    got = hits.withColumn("rerank_score", score).withColumn("_failed", F.max(F.col("rerank_score").isNull()).over(own) | (F.count(F.lit(1)).over(own) <= 1))
    got = got.withColumn("rerank_score", F.when(~F.col("_failed"), F.col("rerank_score")))
    got = got.withColumn("_n", F.row_number().over(own.orderBy(F.col("rerank_score").desc_nulls_last(), "rank")))
    return got.where(F.col("_n") <= k).withColumn("rank", F.col("_n")).drop("_n", "_failed")


def expected_hits(texts: DataFrame, expected: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """(item_id, text_id): which expected strings (item_id, text) occur in which texts (text_id, text), in any case; empty strings occur nowhere.

    Strings go to every task as one automaton for each block of at most block_bytes, and each block scans the texts once.
    """
    rows = expected.where("coalesce(text, '') <> ''").select("item_id", F.lower("text").alias("want")).distinct()
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("want"))).first()[0] or 0) // block_bytes))
    schema = T.StructType([T.StructField("item_id", expected.schema["item_id"].dataType), T.StructField("text_id", texts.schema["text_id"].dataType)])

    def of_block(wanted: list) -> DataFrame:
        held = texts.sparkSession.sparkContext.broadcast([(r.want, r.item_id) for r in wanted])  # about block_bytes

        def find(batches: Iterator) -> Iterator:
            import ahocorasick
            import pandas as pd

            ids: dict = {}
            for want, item in held.value:
                ids.setdefault(want, []).append(item)
            a = ahocorasick.Automaton()
            for want, items in ids.items():
                a.add_word(want, items)
            if not ids:
                return
            a.make_automaton()
            for pdf in batches:
                got = [(i, t) for t, text in zip(pdf["text_id"], pdf["text"], strict=True) for i in sorted({x for _, items in a.iter(text or "") for x in items})]
                yield pd.DataFrame(got, columns=["item_id", "text_id"])

        return texts.select("text_id", F.lower("text").alias("text")).mapInPandas(find, schema)

    return in_blocks(rows, "want", blocks, of_block)


def retrieval_hit(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, hit) of questions (qid, expected: array of strings) over retrieved texts (qid, text): any expected string occurs in any of them, in any case; with none expected, whether there is any text."""
    found = results.groupBy("qid").agg(F.collect_list(F.lower("text")).alias("texts"))  # what was retrieved for one question
    got = expected.join(found, "qid", "left")
    any_text = F.size(F.coalesce("texts", F.array().cast("array<string>"))) > 0
    some = F.exists("expected", lambda e: F.exists(F.coalesce("texts", F.array().cast("array<string>")), lambda t: F.contains(t, F.lower(e))))
    return got.select("qid", F.when(F.size(F.coalesce("expected", F.array().cast("array<string>"))) == 0, any_text).otherwise(some).alias("hit"))


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """expected x predicted counts, zero-filled; unknown predictions are `other`, unknown expectations are dropped."""
    grid = pairs.sparkSession.createDataFrame([(e, p) for e in labels for p in [*labels, "other"]], "expected string, predicted string")
    seen = pairs.where(F.col("expected").isin(labels)).withColumn("predicted", F.when(F.col("predicted").isin(labels), F.col("predicted")).otherwise("other"))
    return grid.join(seen.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n")), ["expected", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def prf(decisions: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of boolean columns predicted and actual; 0 where undefined."""
    p, a = F.col("predicted"), F.col("actual")
    c = decisions.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    c = c.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    c = c.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return c.withColumn("accuracy", safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def faithfulness(claims: DataFrame) -> DataFrame:
    """One row from claims (answer, supported): mean support of answers, unsupported rate, totals, answers with an unsupported claim."""
    per = claims.groupBy("answer").agg(F.avg(F.col("supported").cast("double")).alias("score"), F.count_if(~F.col("supported")).alias("bad"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.coalesce(F.avg("score"), F.lit(1.0)), 6).alias("mean"), F.round(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0)), 6).alias("unsupported_rate"), F.coalesce(F.sum("n"), F.lit(0)).alias("claims"), F.count_if(F.col("bad") > 0).alias("answers_with_unsupported"))


def trust(claims: DataFrame, most_bad: int = 10, most_claims: int = 16, most_chars: int = 300) -> DataFrame:
    """For each answer of claims (answer, place, claim, supported): the supported share to 3 places (null without a verdict), how many claims and supported ones, the first unsupported
    ones, and the first of all, with claims cut to their length; lists are comma-joined in order of place."""
    row = F.struct("place", F.substring(F.col("claim").cast("string"), 1, most_chars).alias("claim"), "supported")
    got = claims.groupBy("answer").agg(
        F.bround(F.avg(F.col("supported").cast("double")), 3).alias("score"), F.count("supported").alias("total"), F.count_if("supported").alias("supported"),
        F.array_sort(F.collect_list(F.when(F.col("supported").isNotNull(), row))).alias("l"),
    )
    text = lambda rows, k: F.array_join(F.transform(F.slice(rows, 1, k), lambda x: x["claim"]), ",")
    return got.select("answer", "score", "total", "supported", text(F.filter("l", lambda x: ~x["supported"]), most_bad).alias("unsupported"), text(F.col("l"), most_claims).alias("claims"))


def nearest_rank(values: DataFrame, group: str, value: str, p: float, parts: int | None = None) -> DataFrame:
    """The sorted value at round(p (n - 1)), banker's rounding, of each group: equal values are counted first, and of the distinct ones only the range that holds the rank is looked at."""
    counts = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    return at_rank(ranged(counts, [group], [value], parts), group, value, "_c", F.bround(F.lit(p) * (F.col("_n") - 1)) + 1)


def last_turns(turns: DataFrame, k: int = 6) -> DataFrame:
    """The last k turns of each conversation, with the next index."""
    w = W.partitionBy("conv_id")
    got = turns.withColumn("_r", F.row_number().over(w.orderBy(F.col("turn").desc()))).withColumn("next_index", F.count(F.lit(1)).over(w))
    return got.where(F.col("_r") <= k).drop("_r")


def aged_out(turns: DataFrame, k: int = 6) -> DataFrame:
    """Turns with the turn that leaves the window of the last k when each of them arrives, null while it isn't full."""
    return turns.withColumn("aged", F.lag("turn", k).over(W.partitionBy("conv_id").orderBy("turn")))


def history_block(turns: DataFrame, most: int = 6000, most_answer: int | None = None) -> DataFrame:
    """(conv_id, history): the newest lines `role: text` that fit into the budget, oldest first. Where not even the newest fits, it alone is cut to the budget, with an ellipsis.

    most_answer trims the texts of assistants first, at a word's end.
    """
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col("role") == "assistant", trim_answer(text, most_answer)).otherwise(text) if most_answer else text
    rows = turns.select("conv_id", "turn", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), text).alias("line"))
    own = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = rows.withColumn("used", F.sum(F.char_length("line") + 1).over(own)).withColumn("_n", F.row_number().over(own))
    fits = F.col("used") - 1 <= most
    rows = rows.where(fits | (F.col("_n") == 1)).withColumn("line", F.when(fits, F.col("line")).otherwise(F.concat(F.substring("line", 1, most - 1), F.lit("…"))))
    kept = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))  # a budget's worth
    return kept.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("history"))


def latest(rows: DataFrame, by: str, k: int, group: str | None = None, tie: str | None = None) -> DataFrame:
    """The k newest rows, of each group if one is named; ties by `tie`, descending."""
    order = [F.col(by).desc_nulls_last(), *([F.col(tie).desc()] if tie else [])]
    if group is None:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def job_counts(jobs: DataFrame) -> DataFrame:
    """Per source: total, success, failed, open (queued or running) jobs."""
    one = lambda *s: F.count_if(F.col("status").isin(*s))
    return jobs.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), one("success").alias("success"), one("failed").alias("failed"), one("queued", "running").alias("open"))


def rollup_sources(jobs: DataFrame) -> DataFrame:
    """Status and error of each source from its jobs: unchanged while any is open, error if none succeeded, else success."""
    c = job_counts(jobs)
    status = F.when(F.col("open") > 0, "unchanged").when(F.col("success") == 0, "error").otherwise("success")
    message = F.when(status == "error", F.concat(F.lit("All "), F.col("total").cast("string"), F.lit(" document(s) failed to ingest.")))
    return c.select("source_id", status.alias("status"), F.coalesce(message, F.lit("")).alias("error"))


def job_states(log: DataFrame) -> DataFrame:
    """The state of each job (source_id, document_url) from its log: success is sticky, else the last status by (ts, event_id)."""
    got = log.groupBy("source_id", "document_url").agg(F.count_if(F.col("status") == "success").alias("won"), F.max_by("status", F.struct("ts", "event_id")).alias("last"))
    return got.select("source_id", "document_url", F.when(F.col("won") > 0, "success").otherwise(F.col("last")).alias("status"))


def stuck(log: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Jobs whose last status is running and older than `minutes` at as_of."""
    got = log.groupBy("source_id", "document_url").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))
    return got.where((F.col("status") == "running") & (F.col("ts") < as_of - F.expr(f"interval {minutes} minutes"))).select("source_id", "document_url")
