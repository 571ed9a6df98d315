"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents, cut into pieces of at most `quantum` ids. In each round a queue's credit grows by its
target share of a window (`length` ids) and it sends its next pieces while its credit covers them; what is left, its deficit, is carried to
the next round. The stream of sent pieces is cut into windows of `length` ids. So after any round a queue has sent its
share of all credit less at most one piece, and documents stay whole but for those longer than the quantum and
those at a window's end. A drained queue's share passes to the others in proportion.

A piece whose last id is the e-th of its queue goes out in the first round r with r * share * length >= e: rounds follow by
exact arithmetic (decimals of 38 digits), whatever window, partition or task a piece is in. The stream is then put in
order of (round, queue, place), dealt to buckets of consecutive rounds; a bucket's place in the stream is a sum over a small table of
bucket sizes. There is no bound on the number of sources.

Target shares default to the queues' shares of all ids. Given `targets`, weights are held to a billionth of their
sum; they must be finite and not negative, and one must be positive. A source without a weight, or with weight 0, follows after
all others have ended, such sources in proportion to their sizes: no row is lost.

Defined cases: null texts are empty and give the end id alone; null sources are a source (NULL_SOURCE in targets); repeated rows are
packed each; very long documents are cut into many pieces; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import chunks, encoder, partitions, trimmed, written

LENGTH, QUANTUM, BROADCAST_ROWS = 2048, 512, 500_000
CHUNK = 1_500_000  # bytes of text encoded at once: an encoder then adds under 100 MB to its worker
BUCKET, BUCKETS = 500_000, 100_000  # ids of a bucket of rounds at least; buckets at most, but for one more at each queue's end
NULL_SOURCE = "\x00null"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, queue, block, at (ids of the same queue before it in the block), n, ids."""
    queue = F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        trimmed()
        enc, block, seen, end = encoder(tokenizer), TaskContext.get().partitionId(), {}, np.array([end_id], "<u4").tobytes()
        narrow = max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16
        for batch in batches:
            size = pc.binary_length(batch.column("text")).to_pylist()
            for rows in chunks(list(range(batch.num_rows)), lambda i: size[i] + 50, CHUNK):
                some = batch.slice(rows[0], len(rows))
                queues = some.column("queue").to_pylist()
                ids = [i + end for i in enc.encode(some.column("text"))]
                at, n = [], [len(i) // 4 for i in ids]
                for q, k in zip(queues, n, strict=True):
                    at.append(seen.get(q, 0))
                    seen[q] = at[-1] + k
                if narrow:
                    ids = [np.frombuffer(i, "<u4").astype("<u2").tobytes() for i in ids]
                cols = [some.column("doc_id"), some.column("queue"), pa.array([block] * len(rows), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "queue", "block", "at", "n", "ids"])

    return written(rows.mapInArrow(run, "doc_id long, queue string, block int, at long, n long, ids binary"), "packing", "lz4")


def checked(targets: dict[str, float]) -> dict[str, int]:
    """Weights by source as whole billionths of their sum; those that are 0 are left out."""
    if any(not isfinite(w) or w < 0 for w in targets.values()) or not sum(targets.values()) > 0:
        raise ValueError("targets must be finite, not negative, and not all 0")
    whole = sum(targets.values())
    return {q: max(1, round(w / whole * 10**9)) for q, w in targets.items() if w > 0}


def _weighted(queues: DataFrame, total: int, length: int, targets: dict[str, float] | None) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(queue, weight, whole, skip): a queue's share is weight / whole, its first round comes after `skip`; and (first round, ids a round, at most) of stretches of rounds."""
    if targets is None:
        return queues.select("queue", F.col("size").alias("weight"), F.lit(total).cast("long").alias("whole"), F.lit(0).cast("long").alias("skip")), [(0, float(length))]
    weights = checked(targets)
    whole = sum(weights.values())
    sizes = {r.queue: r.size for r in queues.where(F.col("queue").isin(list(weights))).collect()}  # one row a target at most
    ends = sorted((-(-n * whole // (length * weights[q])), weights[q]) for q, n in sizes.items())  # the round of each queue's last piece
    skip, rest, left, stretches = ends[-1][0] if ends else 0, total - sum(sizes.values()), sum(w for _, w in ends), []
    for first, (end, w) in zip([0, *[e for e, _ in ends]], ends, strict=False):
        if end > first:
            stretches.append((first, length * left / whole))
        left -= w
    table = queues.sparkSession.createDataFrame(list(weights.items()), "queue string, w long")
    got = queues.join(F.broadcast(table), "queue", "left")  # a row a target
    return got.select(
        "queue", F.coalesce("w", "size").alias("weight"), F.when(F.col("w").isNull(), rest).otherwise(whole).cast("long").alias("whole"),
        F.when(F.col("w").isNull(), skip).otherwise(0).cast("long").alias("skip"),
    ), [*stretches, (skip, float(length))]


def _dec(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def _bucket(stretches: list[tuple[int, float]], total: int) -> Column:
    """Consecutive rounds of about as many ids, numbered in order."""
    most = float(max(BUCKET, total // BUCKETS))
    out = F.lit(0).cast("long")
    for k, (first, rate) in enumerate(stretches):
        out = F.when(F.col("round") > first, F.lit(k << 32) + F.floor((F.col("round") - first) * F.lit(rate / most)).cast("long")).otherwise(out)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, targets: dict[str, float] | None = None, quantum: int = QUANTUM) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue. targets: weights by source."""
    spark = docs.sparkSession
    table = _encoded(docs, tokenizer, end_id)
    blocks = written(table.groupBy("queue", "block").agg(F.sum("n").alias("n")), "packing-blocks")
    total = blocks.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], PIECES)
    weights, stretches = _weighted(blocks.groupBy("queue").agg(F.sum("n").alias("size")), total, length, targets)
    before = W.partitionBy("queue").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    starts = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(weights, "queue")
    if blocks.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)

    def cut(rows: DataFrame) -> DataFrame:
        """Pieces of documents with their rounds and buckets."""
        got = rows.join(starts, ["queue", "block"]).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(quantum).cast("long"))))
        got = got.withColumn("len", F.least(F.lit(quantum).cast("long"), F.col("n") - F.col("start"))).withColumn("place", F.col("base") + F.col("at") + F.col("start"))
        credit = _dec("weight") * F.lit(length)
        turn = F.call_function("div", _dec(F.col("place") + F.col("len")) * _dec("whole") + credit - 1, credit)
        return got.withColumn("round", F.col("skip") + turn).withColumn("bucket", _bucket(stretches, total))

    sizes = written(cut(table.drop("ids")).groupBy("bucket").agg(F.sum("len").alias("n")), "packing-buckets")
    bases = sizes.select("bucket", F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # BUCKETS rows at most, and one a target
    width = (F.octet_length("ids") / F.col("n")).cast("int")
    ids = F.substring("ids", (F.col("start") * width + 1).cast("int"), (F.col("len") * width).cast("int"))
    placed = cut(table).select("doc_id", "queue", "n", "start", "len", "round", "place", "bucket", ids.alias("ids")).join(F.broadcast(bases), "bucket")
    dealt = placed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "round", "queue", "place")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, sent = None, 0  # the bucket at hand and its ids so far
        for batch in batches:
            bucket, start, n, size, base = (batch.column(c).to_numpy() for c in ("bucket", "start", "n", "len", "before"))
            ends = np.cumsum(size)
            fresh = np.flatnonzero(np.concatenate(([len(bucket) > 0 and bucket[0] != last], bucket[1:] != bucket[:-1])))
            origin = np.full(len(size), -sent)  # what ends[-1] was, in this batch's count, where the row's bucket began
            for f in fresh.tolist():
                origin[f:] = ends[f] - size[f]
            at = base + ends - size - origin
            last, sent = bucket[-1], int(ends[-1] - origin[-1])
            data = b"".join(i if len(i) == 4 * k else np.frombuffer(i, "<u2").astype("<u4").tobytes() for i, k in zip(batch.column("ids").to_pylist(), size.tolist(), strict=True))
            view = memoryview(data)
            many = (at + size - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(size)), many)  # a part for each window from a piece's first to its last
            win = (at // length)[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            a, z = np.maximum(at[row], win * length), np.minimum((at + size)[row], (win + 1) * length)
            first = 4 * ((ends - size)[row] + a - at[row])
            crc = [zlib.crc32(view[x:y]) for x, y in zip(first.tolist(), (first + 4 * (z - a)).tolist(), strict=True)]
            taken = pa.array(row)
            cols = [pa.array(np.asarray(c, np.int64)) for c in (start[row] + a - at[row], z - a, crc, n[row], win, a - win * length)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), *cols, batch.column("queue").take(taken)], [f.split(" ")[0] for f in PIECES.split(", ")])

    return dealt.mapInArrow(run, PIECES)


def brute_force(lengths: list[tuple[int, str, int]], length: int, targets: dict[str, float] | None = None, quantum: int = QUANTUM) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) by deficit round-robin one round after another, of (document, source, ids) in order; for tests."""
    from fractions import Fraction

    queues: dict[str, list] = {}
    for doc, q, n in lengths:
        queues.setdefault(q, []).extend((doc, s, min(quantum, n - s)) for s in range(0, n, quantum))
    sizes = {q: sum(p[2] for p in ps) for q, ps in queues.items()}
    weights = checked(targets) if targets is not None else dict(sizes)
    held = {q: w for q, w in weights.items() if targets is not None or q in sizes}
    stream = []
    for group, whole in (({q: w for q, w in held.items() if q in queues}, sum(held.values())), ({q: n for q, n in sizes.items() if q not in held}, sum(n for q, n in sizes.items() if q not in held))):
        credit = dict.fromkeys(group, Fraction(0))
        while any(queues[q] for q in group):
            for q in sorted(group):
                credit[q] += Fraction(length * group[q], whole)
                while queues[q] and queues[q][0][2] <= credit[q]:
                    credit[q] -= queues[q][0][2]
                    stream.append(queues[q].pop(0))
    out, at = [], 0
    for doc, start, n in stream:
        while n:
            one = min(n, length - at % length)
            out.append((doc, start, one, at // length, at % length))
            at, start, n = at + one, start + one, n - one
    return out
