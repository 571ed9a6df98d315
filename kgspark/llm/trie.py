"""Conversation prefix trie from padded matrices of turn ids.

A conversation is the row of its turns' 16-byte ids (of role and text), so conversations that share a prefix are neighbours in
the order of rows. Equal rows are counted before anything else, as one row with a number of members. Distinct rows are
range-partitioned by their order; each partition is cut into padded matrices of at most `CELLS` turns. In a matrix rows are put in order
by `numpy.lexsort`; a column's change mask, OR-accumulated over the columns before it, marks where a node starts at that depth, and
`reduceat` over these starts aggregates every depth.

A matrix knows the row before and the row after it (partitions get theirs as extra rows). So each row tells by its two neighbours whether it is the first of
its node at each depth and whether any row extends it, and all sums over a subtree are sums over rows: leaves are rows that none
extends; what a row saves is its members times its code points below the node, less those of nodes of which it is the first row.
A node that spans matrices therefore is the plain sum of its parts. Only such boundary nodes are shuffled again.

Only ids and lengths are shuffled, never texts. A conversation's ids are held at once (20 bytes a turn). The conversations that end at
one node are digested one at a time, sorted by Spark, as a digest can't be computed in parts.

Defined cases: null role or text: empty; null turns come first; equal turns are ordered by the md5 of role and text; repeated rows are a
turn each; rows of a null conv_id belong to no conversation; a conversation without turns ends at the root; very long texts count by code
points; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import forget, partitions, written

CELLS, PART_BYTES = 500_000, 16 << 20
BYTES = 16  # of a turn's id
NO_ENDS = sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (known, turn, id, chars) in order) of rows (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct(
        F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.char_length(text).alias("chars"),
    )
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(convs: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Each conversation with its first `shared` (`most` at most) turns replaced by those of conversation `base`, if there is one."""
    rows = convs.withColumn("_base", base).withColumn("_shared", shared)
    heads = convs.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head")).join(rows.select("_base").distinct(), "_base", "left_semi")
    own = F.slice("turns", F.col("_shared") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_shared"))
    return rows.join(heads, "_base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """(key, chars, members, first, ends) of each distinct sequence of turns: its ids end to end, its code points, how many conversations have it, the least, their digest."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = written(convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "trie-conversations")
    own = rows.withColumn("seq", F.md5("key"))
    seqs = own.groupBy("seq").agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("first"))
    many = own.select("seq", "conv_id").join(seqs.where("members > 1").select("seq"), "seq", "left_semi")
    several = _digests(many)
    seqs = seqs.join(several, "seq", "left").select("first", "members", F.coalesce("ends", F.sha2(F.col("first").cast("string"), 256)).alias("ends"))
    got = written(rows.select(F.col("conv_id").alias("first"), "key", "chars").join(seqs, "first"), "trie-sequences")
    forget(rows)
    return got


def _digests(members: DataFrame) -> DataFrame:
    """(seq, ends): SHA-256 of each sequence's conv_ids, ascending and comma-joined, one at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seq, state, done = None, None, []
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != seq:
                    if seq is not None:
                        done.append((seq, state.hexdigest()))
                    seq, state = s, sha256(str(c).encode())
                else:
                    state.update(f",{c}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["seq", "ends"])
                done = []
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([state.hexdigest()])], ["seq", "ends"])

    rows = members.repartition(partitions(members.sparkSession), "seq").sortWithinPartitions("seq", "conv_id")
    return rows.mapInArrow(run, "seq string, ends string")


def _shared(a: bytes, b: bytes) -> int:
    """How many first turns two keys have in common."""
    import numpy as np

    n = min(len(a), len(b)) // BYTES
    x, y = (np.frombuffer(k, f"S{BYTES}", n) for k in (a, b))
    other = np.flatnonzero(x != y)
    return int(other[0]) if len(other) else n


def matrix_nodes(rows: list[tuple], before: bytes | None, after: bytes | None) -> dict[str, list]:
    """Columns of NODES for the trie of rows (key, chars, members, first, ends), distinct keys that stand between the rows `before` and `after`.

    `node` and `parent` (digests of the prefix) are set for boundary nodes and for children of boundary nodes alone.
    """
    import numpy as np
    import xxhash

    n = len(rows)
    size = np.array([len(r[0]) // BYTES for r in rows])
    width = int(size.max())
    _, dense = np.unique(np.frombuffer(b"".join(r[0] for r in rows), f"S{BYTES}"), return_inverse=True)  # in the order of bytes
    inside = np.arange(width) < size[:, None]
    ids, chars = np.full((n, width), -1, np.int64), np.zeros((n, width), np.int64)
    ids[inside] = dense
    chars[inside] = np.concatenate([np.asarray(r[1], np.int64) for r in rows])
    order = np.lexsort(ids.T[::-1]) if width else np.arange(n)
    ids, chars, size = ids[order], chars[order], size[order]
    members, least = (np.array([rows[i][c] for i in order], np.int64) for c in (2, 3))
    keys, ends = [rows[i][0] for i in order], [rows[i][4] for i in order]

    lead = min(_shared(before, keys[0]), width) if before is not None else -1  # the depth down to which the matrix's first node began before
    last = _shared(after, keys[-1]) if after is not None else -1
    new = np.ones((n, width), bool)  # the row is the first of its node at depth column + 1
    if n > 1 and width:
        new[1:] = np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1)
    if lead > 0:
        new[0, :lead] = False
    new &= np.arange(width) < size[:, None]
    leaf = np.ones(n, np.int64)
    leaf[:-1] = [b[: len(a)] != a for a, b in zip(keys, keys[1:], strict=False)]
    if after is not None:
        leaf[-1] = after[: len(keys[-1])] != keys[-1]
    saves = np.zeros((n, width + 1), np.int64)
    saves[:, :width] = np.cumsum((chars * (members[:, None] - new))[:, ::-1], axis=1)[:, ::-1]
    tail = np.concatenate([saves[:, :1], saves[:, :width]], axis=1)  # from depth d on: the root's own text is empty

    def path(key: bytes, depth: int) -> list[bytes]:
        """Digests of the key's prefixes from the root to `depth`."""
        h = xxhash.xxh3_128(b"root")
        got = [h.digest()]
        for d in range(depth):
            h.update(key[d * BYTES : (d + 1) * BYTES])
            got.append(h.digest())
        return got

    firsts, lasts = path(keys[0], lead) if lead >= 0 else [], path(keys[-1], last) if last >= 0 else []
    out: dict[str, list] = {f.split(" ")[0]: [] for f in NODES.split(", ")}
    above, above_conv, above_edge = None, None, []
    for d in range(width + 1):
        at = np.flatnonzero(size >= d)
        start = np.zeros(n, bool)
        start[at[0]] = True
        if d:
            start |= new[:, d - 1]
            start[0] &= size[0] >= d
        flags = start[at]
        first = np.flatnonzero(flags)
        total = lambda x: np.add.reduceat(x[at], first)  # noqa: B023, E731
        conv = np.minimum.reduceat(least[at], first)
        index = np.full(n, -1)
        index[at] = np.cumsum(flags) - 1
        k = len(first)
        edge: list = [None] * k
        if d < len(firsts):
            edge[0] = firsts[d]
        if d < len(lasts):
            edge[-1] = lasts[d]
        own = [NO_ENDS] * k
        for i in np.flatnonzero(size == d).tolist():
            own[index[i]] = ends[i]
        parents = above[at[first]] if d else np.full(k, -1)
        up = [above_edge[p] if p >= 0 else None for p in parents.tolist()]
        out["conv_id"] += conv.tolist()
        out["depth"] += [d] * k
        out["parent_conv_id"] += [None if p < 0 or u is not None else int(above_conv[p]) for p, u in zip(parents.tolist(), up, strict=True)]
        out["n_convs"] += total(members).tolist()
        out["n_children"] += (total(new[:, d].astype(np.int64)) if d < width else np.zeros(k, np.int64)).tolist()
        out["n_leaves"] += total(leaf).tolist()
        out["saved_tokens"] += total(tail[:, d]).tolist()
        out["ends_sha256"] += own
        out["node"] += edge
        out["parent"] += up
        above, above_conv, above_edge = index, conv, edge
    return out


def _parts(seqs: DataFrame) -> DataFrame:
    """seqs in range partitions by key (column part), each with the last row of the one before (halo -1) and the first of the one after (halo 1)."""
    spark = seqs.sparkSession
    size = seqs.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    n = max(partitions(spark), -(-size // PART_BYTES))
    dealt = written(seqs.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "trie-parts")
    edges = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    near = W.orderBy("part")  # one row a partition
    edges = edges.select("part", F.lag("high").over(near).alias("before"), F.lead("low").over(near).alias("after"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("chars", "array<int>"), ("members", "long"), ("first", "long"), ("ends", "string"))]
    halo = edges.select("part", F.explode(F.array(F.struct(F.lit(-1).alias("halo"), F.col("before").alias("key")), F.struct(F.lit(1).alias("halo"), F.col("after").alias("key")))).alias("h"))
    halo = halo.select("part", "h.halo", "h.key", *none).where("key is not null")
    rows = dealt.select("part", F.lit(0).alias("halo"), "key", "chars", "members", "first", "ends").unionByName(halo)
    return rows.repartitionById(n, "part").sortWithinPartitions("part", "key")


def trie(convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row for each node of the trie of conversations (conv_id, turns)."""
    seqs = sequences(convs)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.split(" ")[0] for f in NODES.split(", ")]
        types = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]

        def out(rows: list, before: bytes | None, after: bytes | None):  # noqa: ANN202
            got = matrix_nodes(rows, before, after)
            return pa.RecordBatch.from_arrays([pa.array(got[c], t) for c, t in zip(names, types, strict=True)], names)

        held, width, part, before = [], 0, None, None
        for batch in batches:
            for p, halo, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "halo", "key", "chars", "members", "first", "ends")), strict=True):
                turns = len(row[0]) // BYTES
                if held and (p != part or halo > 0 or (len(held) + 1) * max(width, turns, 1) > cells):
                    yield out(held, before, row[0] if p == part else None)
                    before = held[-1][0]
                    held, width = [], 0
                if p != part:
                    part, before = p, None
                if halo:
                    before = row[0]
                else:
                    held.append(tuple(row))
                    width = max(width, turns)
        if held:
            yield out(held, before, None)

    nodes = written(_parts(seqs).mapInArrow(run, NODES), "trie-nodes")
    forget(seqs)
    edge = nodes.where("node is not null").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min(F.when(F.col("ends_sha256") != F.lit(NO_ENDS), F.col("ends_sha256"))).alias("ends"),
    )
    edge = written(edge.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))), "trie-edges")
    ups = edge.select(F.col("node").alias("parent"), F.col("conv_id").alias("_up"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = edge.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*cols, "parent")
    inner = nodes.where("node is null").select(*cols, "parent")
    waiting = whole.unionByName(inner.where("parent is not null")).join(ups, "parent", "left").withColumn("parent_conv_id", F.col("_up"))
    return inner.where("parent is null").select(*cols).unionByName(waiting.select(*cols))


def brute_force(convs: dict[int, list[tuple[str, str]]]) -> dict[tuple, tuple]:
    """prefix -> the node's columns, from every prefix of every conversation; for tests."""
    prefixes = {tuple(t[:d]) for t in convs.values() for d in range(len(t) + 1)}
    got = {}
    for p in prefixes:
        d = len(p)
        inside = [c for c, t in convs.items() if tuple(t[:d]) == p]
        below = [q for q in prefixes if q[:d] == p]
        kids = lambda q: sum(len(r) == len(q) + 1 and r[: len(q)] == q for r in prefixes)
        of = lambda q: sum(tuple(t[: len(q)]) == q for t in convs.values())
        up = min(c for c, t in convs.items() if tuple(t[: d - 1]) == p[:-1]) if d else None
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(convs[c]) == d))
        saved = sum((of(q) - 1) * len(q[-1][1]) for q in below if q)
        got[p] = (min(inside), d, up, len(inside), kids(p), sum(kids(q) == 0 for q in below), saved, sha256(ends.encode()).hexdigest())
    return got
