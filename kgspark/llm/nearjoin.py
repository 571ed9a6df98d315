"""N-gram Jaccard self-join by chosen paths: links between texts of shingle likeness `least` or more, and their classes.

A text is its set of five-word shingle hashes. Equal sets are one representative from the start. In each of `runs` runs a
set follows every token j with hash(run, j) < FANS[0] / |set|, so sets of high overlap meet in some token's bucket. A
bucket above `limit` sets or `TOKENS` tokens is split: below each path a set follows the tokens with hash(path, j) <
FANS[level] / |set|, of a fixed pool of its tokens. Other buckets are compared pair by pair. Paths are chosen for each run and each path apart, so whole
paths fail independently: with q = 0 beyond the last level and q = exp(-least * fan * (1 - q)) from the last to the first, a link is
missed by all runs with probability at most q ** runs, whatever was split. `runs` is chosen for the target recall: 8 runs of
fans 2, 4, 4 give 5e-6. Buckets that a split would not make cheaper (thousands of true near copies) or that are still
large after the last level are compared block by block, so nothing is capped.

A group of near copies meets in many buckets with nearly the same members. A bucket most of whose members are in one larger bucket is
merged into that one, so that each set's tokens go to few tasks. A pair is counted only in the least bucket that
both its sets are in. So links are counted and spanning edges found inside tasks, and no table of pairs is ever made.

Defined cases: null texts are empty; texts of one to four words have one shingle; texts without words are
copies of equal texts only; repeated rows are copies; a null doc_id gets a class but never names one unless
the whole class has null ids; an empty table gives no rows; extra columns are ignored, and kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import chunks, forget, partitions, unburdened, words_of, written

SHINGLE, LEAST, RECALL = 5, 0.8, 0.99999
#: Tokens that a set follows on average: in each run at first, then below each path.
FANS = (2.0, 4.0, 4.0)
#: What one task compares at once: sets and tokens of a bucket, or of two blocks of a larger one.
LIMIT, TOKENS = 3000, 4_000_000
POOL = 64  # tokens of a set, on average, from which paths below the first are chosen
ROWS = "doc_id long, thash string, skey binary, n long, tokens binary, keys array<long>"
BITS = 40  # of a token: two of the 40,000 tokens of a pair of very long texts are equal by chance in one pair of 700


def _mix(x):  # noqa: ANN001, ANN202
    """A 64-bit finalizer over an array."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], cache: dict, size: int = SHINGLE) -> list:
    """The sorted distinct 64-bit shingle hashes of each text."""
    import numpy as np
    import xxhash

    out = []
    for t in texts:
        words = words_of(t)
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        if len(cache) > 150_000:
            cache.clear()
        with np.errstate(over="ignore"):
            n = max(1, len(h) - size + 1) if len(h) else 0
            s = np.zeros(n, np.uint64)
            for k in range(min(size, len(h))):
                s = _mix(s + h[k : k + n] + np.uint64(k + 1))
        out.append(np.unique(s))
    return out


def packed(tokens) -> bytes:  # noqa: ANN001
    """Sorted tokens below 2 ** BITS as differences: their low 32 bits, then their high bits."""
    import numpy as np

    d = np.diff(tokens, prepend=np.uint64(0))
    return d.astype("<u4").tobytes() + (d >> np.uint64(32)).astype("u1").tobytes()


def unpacked(data: bytes):  # noqa: ANN201
    import numpy as np

    n = len(data) // 5
    return np.cumsum(np.frombuffer(data, "<u4", n).astype(np.uint64) + (np.frombuffer(data, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32)), dtype=np.uint64)


def _followed(tokens, seed: int, share: float):  # noqa: ANN001, ANN202
    """Keys of the paths that a set follows below the one of `seed`, by about `share` of the given tokens."""
    import numpy as np

    with np.errstate(over="ignore"):
        at = _mix(np.array([seed], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        h = _mix(tokens + at)
        low = h <= np.uint64(min(share, 1.0) * (2**64 - 2048))
        return np.unique(_mix(h[low] ^ at)).view(np.int64)


def missed(least: float = LEAST, fans: tuple[float, ...] = FANS) -> float:
    """The most probable share of links that one run misses, if every bucket but the last is split."""
    q = 0.0
    for fan in reversed(fans):
        q = exp(-least * fan * (1 - q))
    return q


def runs_for(least: float = LEAST, fans: tuple[float, ...] = FANS, recall: float = RECALL) -> int:
    return ceil(log(1 - recall) / log(missed(least, fans)))


def signed(docs: DataFrame, least: float = LEAST, recall: float = RECALL, fans: tuple[float, ...] = FANS) -> DataFrame:
    """One row for each document: its text's hash, set key, number of tokens, tokens (null where its task gave that set's before) and path keys."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("thash"), F.coalesce("text", F.lit("")).alias("text"))
    runs = runs_for(least, fans, recall)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        unburdened()
        cache: dict = {}
        given: set = set()
        for batch in batches:
            texts = batch.column(2)
            for at in chunks(list(range(batch.num_rows)), lambda i: texts[i].as_buffer().size + 50, 1_500_000):
                part = batch.slice(at[0], len(at))
                cols: list[list] = [[] for _ in range(4)]
                for h, s in zip(part.column(1).to_pylist(), shingle_sets(part.column(2).to_pylist(), cache), strict=True):
                    short = np.unique(s >> np.uint64(64 - BITS))
                    key = xxhash.xxh3_128_digest(s.tobytes() if len(s) else b"empty " + h.encode())
                    cols[0].append(key)
                    cols[1].append(len(short))
                    cols[2].append(None if key in given else packed(short))
                    cols[3].append(np.concatenate([_followed(short, r, fans[0] / max(1, len(short))) for r in range(runs)]))
                    given.add(key)
                if len(given) > 500_000:
                    given.clear()
                kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [f.split(" ")[0] for f in ROWS.split(", ")])

    return written(rows.mapInArrow(run, ROWS), "nearjoin-rows")


def _tokens(docs_signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(skey, tokens) of wanted sets, each once."""
    return docs_signed.where("tokens is not null").select("skey", "tokens").join(wanted, "skey", "left_semi").dropDuplicates(["skey"])


def _pools(docs_signed: DataFrame) -> DataFrame:
    """(skey, pool): of each set about POOL tokens, the same ones for all paths, from which deeper paths are chosen: a split then moves a few hundred bytes a set."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            pools = []
            for data in batch.column(1).to_pylist():
                tokens = unpacked(data)
                with np.errstate(over="ignore"):
                    low = _mix(tokens + np.uint64(0xD6E8FEB86659FD93)) <= np.uint64(min(POOL / max(1, len(tokens)), 1.0) * (2**64 - 2048))
                pools.append(packed(tokens[low]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pools, pa.binary())], ["skey", "pool"])

    return docs_signed.where("tokens is not null").select("skey", "tokens").mapInArrow(run, "skey binary, pool binary")


def _split(large: DataFrame, docs_signed: DataFrame, fan: float) -> DataFrame:
    """(path, child, skey, n) of the members (skey, n, path) of large buckets, below each path the tokens that they follow."""
    paths = large.groupBy("skey", "n").agg(F.collect_list("path").alias("paths"))  # a set has a path for each token that it follows

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part, out = batch.slice(first, 1000), []
                for i, (n, paths, data) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    tokens = unpacked(data)
                    for p in paths:
                        kids = _followed(tokens, p, fan / max(1, min(n, POOL)))
                        out.append((np.full(len(kids), i), np.full(len(kids), p, np.int64), kids))
                at, path, child = (np.concatenate(c) for c in zip(*out, strict=True))
                row = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(child), part.column(0).take(row), part.column(1).take(row)], ["path", "child", "skey", "n"])

    pools = _pools(docs_signed).join(paths.select("skey"), "skey", "left_semi").dropDuplicates(["skey"])
    rows = paths.join(pools, "skey").select("skey", "n", "paths", "pool")
    return written(rows.mapInArrow(run, "path long, child long, skey binary, n long"), "nearjoin-split")


def _large(limit: int) -> Column:
    return (F.col("size") > limit) | (F.col("weight") > TOKENS)


def _sized(paths: DataFrame, least: float) -> DataFrame:
    """paths (path, skey, n) with size and weight of their buckets, without those of which no other member has a like number of tokens.

    Numbers of tokens of a link differ by a factor of 1 / least at most, so they are in the same class or in adjacent ones. A bucket's mask has a bit for each class; where a
    class may hold several members, all stay.
    """
    step = F.floor(F.ln(F.greatest("n", F.lit(1)).cast("double")) / F.lit(log(1.0001 / least))).cast("int")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("_class") + k, F.lit(64)))
    paths = paths.withColumn("_class", step)
    sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.bit_or(bit(0)).alias("mask")).where("size > 1")
    alive = (F.col("mask").bitwiseAND(bit(1).bitwiseOR(bit(63))) != 0) | (F.col("size") > F.bit_count("mask"))
    return paths.join(sizes, "path").where(alive).select("path", "size", "weight", "skey", "n")


def _alike(large: DataFrame, held: DataFrame, limit: int, keys: float, fan: float) -> DataFrame:
    """(path) of large buckets whose members share so many of the wide buckets of `held`, of `keys` a set, that a split would save no comparisons.

    The share of keys that two members have in common, on average, is about their likeness; a split with `fan` makes about fan * likeness of the pairs again.
    """
    wide = held.where((F.col("size") > limit // 2) | (F.col("weight") > TOKENS // 2)).select("skey", F.col("path").alias("other"))
    both = large.select("path", "size", "skey").join(wide, "skey").groupBy("path", "size", "other").agg(F.count(F.lit(1)).cast("double").alias("k"))
    shared = F.sum(F.pow(F.col("k") / F.col("size"), F.lit(2.0)))
    return written(both.groupBy("path").agg(shared.alias("shared")).where(F.col("shared") * fan >= keys).select("path"), "nearjoin-alike")


def _met(reps: DataFrame, docs_signed: DataFrame, limit: int, least: float, recall: float, fans: tuple[float, ...]) -> DataFrame:
    """(path, size, skey, n) of all buckets to compare."""
    paths, found, first = reps.select("skey", F.col("width").alias("n"), F.explode("keys").alias("path")), [], None
    for level in range(len(fans)):
        held = written(_sized(paths, least), f"nearjoin-paths{level}")
        first = held if first is None else first
        if level == len(fans) - 1:
            return _every([*found, held])
        found.append(held.where(~_large(limit)))
        large = held.where(_large(limit))
        if large.limit(1).count() == 0:
            return _every(found)
        alike = _alike(large, first, limit, runs_for(least, fans, recall) * fans[0], fans[level + 1])
        found.append(large.join(alike, "path", "left_semi"))
        large = large.join(alike, "path", "left_anti")
        kids = _split(large, docs_signed, fans[level + 1])
        work = kids.groupBy("path", "child").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("path").agg(F.sum(F.col("k") * F.col("k")).alias("work"))
        vain = large.select("path", "size").distinct().join(work, "path").where(F.col("work") >= F.col("size").cast("double") * F.col("size"))
        vain = written(vain.select("path"), "nearjoin-vain")  # here too all pairs of the bucket are compared
        found.append(large.join(vain, "path", "left_semi"))
        paths = kids.join(vain, "path", "left_anti").select("skey", "n", F.col("child").alias("path"))
    return _every(found)


def _every(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("path", "size", "skey", "n")


def _roots(parents: DataFrame) -> DataFrame:
    """(path, root): the last of each path's chain of parents (path, root), by doubling; each round is a written table."""
    while True:
        far = parents.select(F.col("path").alias("root"), F.col("root").alias("_far"))
        last = parents
        parents = written(parents.join(far, "root", "left").select("path", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("on")), "nearjoin-roots")
        forget(last)
        if parents.where("on").limit(1).count() == 0:
            return parents.select("path", "root")


def _merged(met: DataFrame) -> DataFrame:
    """(bucket, skey, n): buckets of which half or more of the members have the same larger one as their largest are merged into it."""
    lists = met.groupBy("skey").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("d"), "path"))).alias("l")).where("size(l) > 1")
    pairs = lists.select(F.col("l")[0]["path"].alias("root"), F.explode(F.slice("l", 2, F.size("l"))).alias("p")).groupBy("root", F.col("p.path").alias("path"), (-F.col("p.d")).alias("size")).agg(F.count(F.lit(1)).alias("both"))
    parents = pairs.where("both * 2 >= size").groupBy("path").agg(F.max_by("root", F.struct("both", "root")).alias("root"))
    roots = _roots(written(parents, "nearjoin-parents"))
    return met.join(roots, "path", "left").select(F.coalesce("root", "path").alias("bucket"), "skey", "n").distinct()


def _compared(m: list, least: float, bucket: int):  # noqa: ANN202
    """For one unit of (skey, copies, tokens, sorted buckets, block): links, links weighted by copies, and the least member that each reaches.

    Between two blocks of a bucket only pairs of different blocks count; inside one block, and in a whole bucket, block is null.
    """
    import numpy as np

    n = len(m)
    size = np.array([len(x[2]) for x in m])
    owner, every = np.repeat(np.arange(n), size), np.concatenate([x[2] for x in m])
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    df = np.diff(np.append(first, len(every)))
    shared = np.zeros((n, n), np.float32)
    for d in np.unique(df[(df > 1) & (df <= 24)]):  # rare tokens: count their few pairs
        rows = owner[first[df == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        np.add.at(shared, (rows[:, i].ravel(), rows[:, j].ravel()), 1)
    shared = shared + shared.T
    wide, width = np.flatnonzero(df > 24), max(64, 4_000_000 // n)
    for at in range(0, len(wide), width):  # common tokens: a product of incidence matrices
        x = np.zeros((n, min(width, len(wide) - at)), np.float32)
        for c, t in enumerate(wide[at : at + width]):
            x[owner[first[t] : first[t] + df[t]], c] = 1
        shared += x @ x.T
    near = np.empty((n, n), bool)
    for i in range(0, n, 500):
        near[i : i + 500] = shared[i : i + 500] >= least * (size[i : i + 500, None] + size[None, :] - shared[i : i + 500]) - 1e-4
    np.fill_diagonal(near, False)
    if m[0][4] is not None:
        block = np.array([x[4] for x in m])
        near &= block[:, None] != block[None, :]
    if near.any():  # of the pairs' common buckets only the least one counts them
        lower = sorted({b for x in m for b in x[3] if b < bucket})
        if lower:
            col = {b: c for c, b in enumerate(lower)}
            x = np.zeros((n, len(lower)), np.float32)
            for i, r in enumerate(m):
                x[i, [col[b] for b in r[3] if b < bucket]] = 1
            x = x[:, x.sum(0) > 1]
            near &= (x @ x.T) == 0
    root = np.arange(n)
    while near.any():
        new = np.minimum(root, np.concatenate([np.where(near[i : i + 500], root[None, :], n).min(1) for i in range(0, n, 500)]))
        if (new == root).all():
            break
        root = new
    return near.sum(1), near @ np.array([x[1] for x in m]), root


def _units(buckets: DataFrame, limit: int) -> DataFrame:
    """(unit, bucket, skey, block): what is compared at once, a bucket of at most `limit` sets and TOKENS tokens or one block or two of a larger one (block: null but between two)."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1")
    blocks = F.when(_large(limit), F.greatest(F.ceil(F.col("size") * 2 / limit), F.ceil(F.col("weight") * 2 / TOKENS), F.lit(2))).otherwise(1).cast("int")
    rows = buckets.join(sizes.select("bucket", blocks.alias("blocks")), "bucket")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("skey", F.lit(3)), F.col("blocks")).cast("int"))
    two = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("a"), F.greatest(b, F.col("block")).alias("b")))
    return rows.withColumn("two", F.explode(two)).select(F.when(F.col("blocks") > 1, F.xxhash64("bucket", "two")).otherwise(F.col("bucket")).alias("unit"), "bucket", "skey", F.when(F.col("two.a") < F.col("two.b"), F.col("block")).alias("block"))


def links(docs_signed: DataFrame, least: float = LEAST, limit: int = LIMIT, recall: float = RECALL, fans: tuple[float, ...] = FANS) -> tuple[DataFrame, DataFrame]:
    """(reps with copies, per set and bucket: links, weighted links and the set reached)."""
    reps = docs_signed.groupBy("skey").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("width"), F.first("keys").alias("keys"))
    reps = written(reps, "nearjoin-reps")
    buckets = written(_merged(_met(reps.where("size(keys) > 0"), docs_signed, limit, least, recall, fans)), "nearjoin-buckets")
    places = buckets.join(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket").groupBy("skey").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    places = written(places.join(reps.select("skey", "copies"), "skey"), "nearjoin-places")
    sets = places.join(_tokens(docs_signed, places.select("skey")), "skey")
    rows = _units(buckets, limit).join(sets, "skey")
    spark = docs_signed.sparkSession

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def done(m: list, bucket: int):  # noqa: ANN202
            n_links, weighted, root = _compared(m, least, bucket)
            keep = np.flatnonzero(n_links)
            return [(m[i][0], int(n_links[i]), int(weighted[i]), m[root[i]][0]) for i in keep]

        unburdened()
        held, unit, bucket, out = [], None, 0, []
        names, kinds = ("skey", "links", "weighted", "root"), (pa.binary(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for u, b, skey, block, copies, tokens, own in zip(*(batch.column(c).to_pylist() for c in ("unit", "bucket", "skey", "block", "copies", "tokens", "buckets")), strict=True):
                if u != unit:
                    if len(held) > 1:
                        out += done(held, bucket)
                    held, unit, bucket = [], u, b
                held.append((skey, copies, unpacked(tokens), own, block))
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))
                out = []
        if len(held) > 1:
            out += done(held, bucket)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    dealt = rows.select("unit", "bucket", "skey", "block", "copies", "tokens", "buckets").repartition(partitions(spark), "unit").sortWithinPartitions("unit", "skey")
    found = written(dealt.mapInArrow(run, "skey binary, links long, weighted long, root binary"), "nearjoin-links")
    forget(buckets, places)
    return reps, found


def components(edges: DataFrame) -> DataFrame:
    """(a, label): the least node reachable from each node of edges (a, b), by min-label rounds with shortcuts; each round is a written table."""
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")), "components")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, "a").select("a", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = step.alias("s").join(labels.select(F.col("a").alias("_a"), F.col("label").alias("_l")), F.col("s.label") == F.col("_a"), "left")
        last, labels = labels, written(jump.select("a", F.least("s.label", F.coalesce("_l", "s.label")).alias("label"), "old"), "components")
        forget(last)
        if labels.where("label <> old").limit(1).count() == 0:
            forget(both)
            return labels.select("a", "label")


def classes(docs: DataFrame, least: float = LEAST, limit: int = LIMIT) -> DataFrame:
    """doc_id, thash, class_key, class_id (least doc_id of the class), n_copies, n_links (other documents linked), n_text_links (other texts linked)."""
    rows = signed(docs, least)
    reps, found = links(rows, least, limit)
    sums = found.groupBy("skey").agg(F.sum("links").alias("text_links"), F.sum("weighted").alias("doc_links"))
    label = components(found.select(F.col("skey").alias("a"), F.col("root").alias("b")))
    known = reps.select("skey", "first", "copies").join(sums, "skey", "left").join(label.withColumnRenamed("a", "skey"), "skey", "left").withColumn("class_key", F.coalesce("label", "skey"))
    heads = known.groupBy("class_key").agg(F.min("first").alias("class_id"))
    known = written(known.join(heads, "class_key").select("skey", "class_key", "class_id", "copies", "text_links", "doc_links"), "nearjoin-classes")
    forget(reps, found)
    return rows.select("doc_id", "thash", "skey").join(known, "skey").select(
        "doc_id", "thash", "class_key", "class_id", F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.coalesce("doc_links", F.lit(0))).alias("n_links"), F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
    )


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, that come first (by doc_id, then text hash) in their class: one row each."""
    keep = classes(docs, least).groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias("_id"), F.col("k.thash").alias("_hash"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_own"), F.md5(F.coalesce("text", F.lit(""))).alias("_text"))
    kept = rows.join(keep, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["_own", "_text"]).select("row.*")


def brute_force(texts: dict[int, str | None], least: float = LEAST) -> dict[int, set[int]]:
    """Links between documents by comparing all pairs; for tests."""
    got: dict[int, set[int]] = {d: set() for d in texts}
    words = {d: words_of(t) for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set() for d, w in words.items()}
    ids = list(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if (both >= least * (len(sets[a]) + len(sets[b]) - both)) if sets[a] and sets[b] else (texts[a] or "") == (texts[b] or ""):
                got[a].add(b), got[b].add(a)
    return got
