"""Near-duplicate groups by SuperMinHash: signatures, banding, verification on full sets, union-find.

A text is its set of distinct shingles of `SHINGLE` words. Each element visits the `M` registers of its set in an order of its own (a Fisher-Yates
permutation drawn from its hash); at step j it offers j plus a fraction. A register keeps the least offer, so ranks of one element are correlated and the
share of equal registers has a lower variance than with independent ones. Once every register of a set is below j + 1 no later step can
change it, and the set stops: after a step or two for usual texts.

Registers are cut into `BANDS` bands. Sets with an equal band meet in a bucket: a pair of likeness s in none with probability
(1 - s ** ROWS) ** BANDS, 3e-6 at the threshold. In each bucket every set is compared with the least one, so a bucket of n near copies costs n
comparisons, not n * n; pairs are first tried by their sizes and signatures (a cut of `SIGMAS` deviations below the threshold), then counted on
full sets. Confirmed links are joined to components. Buckets that still hold several components afterwards have all pairs compared, by blocks; members of nearly
the same buckets are compared once. So every pair that meets is decided, and nothing is capped.

Words are runs of `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased.

Defined cases: null texts are empty; a text of one word is the set of that word; texts without words are empty sets and linked with nothing, each other
included; repeated rows are linked copies; a null doc_id takes part but names a component only if no row of it has an id, and is kept only then; an empty table gives no
rows; very long texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import chunks, forget, partitions, written
from kgspark.llm.nearjoin import BITS, _compared, _merged, _mix, _units, components, packed, unpacked
from kgspark.llm.suffixtree import tokens_of

SHINGLE, PERCENT = 2, 80
ROWS, BANDS = 4, 24
M = ROWS * BANDS
SIGMAS = 6.0
#: What one task compares at once: sets of a bucket or of two blocks of a larger one; members that share a task with their bucket's least set.
LIMIT, STAR = 3000, 2000
SETS = "doc_id long, skey binary, n long, uid long, tokens binary, registers binary, keys array<long>"


def shingle_sets(texts: list[bytes], cache: dict, size: int = SHINGLE) -> list:
    """The sorted distinct 64-bit shingle hashes of each UTF-8 text."""
    import numpy as np
    import xxhash

    out = []
    for t in texts:
        words = tokens_of(t)
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


def signatures(sets: list, m: int = M):  # noqa: ANN201
    """One row of m registers (64 bits of the least offer) for each non-empty set of hashes."""
    import numpy as np

    n = np.array([len(s) for s in sets])
    offers = np.full(len(sets) * m, np.inf)
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    swaps: list = []  # of the steps so far: which place each element swapped with
    for j in range(m):
        with np.errstate(over="ignore"):
            x = _mix(element + np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) & (1 << 64) - 1))
        place = j + ((x & np.uint64(0xFFFFFF)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
        at = place
        for i in range(j - 1, -1, -1):  # what the earlier swaps left at that place
            at = np.where(at == swaps[i], i, at)
        swaps.append(place)
        np.minimum.at(offers, owner * m + at, j + (x >> np.uint64(24)).astype(np.float64) * 2.0**-40)
        open_sets = offers.reshape(-1, m).max(1) >= j + 1
        stay = open_sets[owner]
        if not stay.any():
            break
        if not stay.all():
            element, owner, swaps = element[stay], owner[stay], [s[stay] for s in swaps]
    return _mix(offers.view(np.uint64)).reshape(-1, m)


def band_keys(registers):  # noqa: ANN001, ANN201
    """int64 keys of the bands of each row of registers."""
    import numpy as np

    with np.errstate(over="ignore"):
        b = registers.reshape(len(registers), BANDS, ROWS)
        h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(ROWS):
            h = _mix(h + b[:, :, k])
    return h.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """A row for each document: its set's key and size (null and 0 for empty sets), a number of its own, and tokens, registers and band keys (null where its task gave that set's before)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        cache: dict = {}
        given: set = set()
        uid = TaskContext.get().partitionId() << 40
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            texts = batch.column(1)
            for at in chunks(list(range(batch.num_rows)), lambda i: texts[i].as_buffer().size + 50, 1_500_000):
                part = batch.slice(at[0], len(at))
                sets = shingle_sets(part.column(1).to_pylist(), cache)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                fresh = [i for i, k in enumerate(keys) if k is not None and k not in given and not given.add(k)]
                tokens, registers, bands = ([None] * len(sets) for _ in range(3))
                if fresh:
                    sig = signatures([sets[i] for i in fresh])
                    for i, r, b in zip(fresh, sig.astype("<u2"), band_keys(sig), strict=True):
                        tokens[i], registers[i], bands[i] = packed(np.unique(sets[i] >> np.uint64(64 - BITS))), r.tobytes(), b
                cols = [keys, [len(s) for s in sets], list(range(uid, uid + len(sets))), tokens, registers, bands]
                uid += len(sets)
                if len(given) > 500_000:
                    given.clear()
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [f.split(" ")[0] for f in SETS.split(", ")])

    return written(rows.mapInArrow(run, SETS), "superminhash-rows")


def _likely(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(lead, uid) of pairs whose sizes and signatures allow the likeness."""
    least = percent / 100
    cut = M * (least - SIGMAS * (least * (1 - least) / M) ** 0.5)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, 20_000):
                part = batch.slice(first, 20_000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("lead_registers", "registers"))
                yield part.select(["lead", "uid"]).filter(pa.array((a == b).sum(1) >= cut))

    sets = held.select("uid", "n", "registers")
    both = pairs.join(sets, "uid").join(sets.select(F.col("uid").alias("lead"), F.col("n").alias("lead_n"), F.col("registers").alias("lead_registers")), "lead")
    sized = both.where(F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent)
    return sized.select("lead", "uid", "lead_registers", "registers").mapInArrow(run, "lead long, uid long")


def _confirmed(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs (lead, uid) whose full sets are linked: `STAR` members at once beside their lead's tokens."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("blocks"))
    units = written(pairs.join(sizes, "lead").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).select("lead", "block", "uid"), "superminhash-units")
    rows = units.unionByName(units.select("lead", "block", F.col("lead").alias("uid")).distinct()).join(tokens, "uid")
    dealt = rows.repartition(partitions(spark), "lead", "block").sortWithinPartitions("lead", "block", F.col("uid") != F.col("lead"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own, unit = None, None
        for batch in batches:
            a, b = [], []
            for lead, block, uid, data in zip(*(batch.column(c).to_pylist() for c in ("lead", "block", "uid", "tokens")), strict=True):
                x = unpacked(data)
                if (lead, block) != unit:
                    unit, own = (lead, block), x  # a unit's first row is its lead
                    continue
                at = np.searchsorted(own, x)
                both = int((own[np.minimum(at, len(own) - 1)] == x).sum())
                if 100 * both >= percent * (len(own) + len(x) - both):
                    a.append(lead)
                    b.append(uid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    got = written(dealt.select("lead", "block", "uid", "tokens").mapInArrow(run, "a long, b long"), "superminhash-links")
    forget(units)
    return got


def _rest(buckets: DataFrame, label: DataFrame, tokens: DataFrame, percent: int, limit: int) -> DataFrame:
    """(a, b) that join what buckets (key, size, uid) of three sets and more still hold apart, from comparing all their pairs by blocks."""
    rows = buckets.where("size > 2").join(label.withColumnRenamed("a", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    apart = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    met = written(rows.join(apart, "key", "left_semi").select(F.col("key").alias("path"), "size", F.col("uid").alias("skey"), F.col("n")), "superminhash-apart")
    merged = written(_merged(met), "superminhash-merged")
    units = _units(merged, limit).join(tokens.withColumnRenamed("uid", "skey"), "skey")
    dealt = units.select("unit", "skey", "block", "tokens").repartition(partitions(buckets.sparkSession), "unit").sortWithinPartitions("unit", "skey")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(m: list):  # noqa: ANN202
            n_links, _, root = _compared(m, percent / 100, 0)
            return [(m[i][0], m[root[i]][0]) for i in range(len(m)) if n_links[i] and root[i] != i]

        held, unit, out = [], None, []
        for batch in batches:
            for u, uid, block, data in zip(*(batch.column(c).to_pylist() for c in ("unit", "skey", "block", "tokens")), strict=True):
                if u != unit:
                    if len(held) > 1:
                        out += done(held)
                    held, unit = [], u
                held.append((uid, 1, unpacked(data), [], block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if len(held) > 1:
            out += done(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    got = written(dealt.mapInArrow(run, "a long, b long"), "superminhash-rest")
    forget(met, merged)
    return got


def groups(docs: DataFrame, percent: int = PERCENT, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept for every row of docs."""
    rows = signed(docs)
    sets = written(rows.where("skey is not null").groupBy("skey").agg(F.min(F.when(F.col("keys").isNotNull(), F.col("uid"))).alias("uid"), F.min("doc_id").alias("first")), "superminhash-sets")
    held = rows.where("keys is not null").join(sets.select("uid"), "uid", "left_semi")
    small = written(held.select("uid", "n", "registers", "keys"), "superminhash-held")
    bands = small.select("uid", "n", F.explode("keys").alias("key"))
    leads = bands.groupBy("key").agg(F.min("uid").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(bands.join(leads, "key"), "superminhash-buckets")
    stars = buckets.where("uid <> lead").select("lead", "uid").distinct()
    likely = written(_likely(stars, small, percent), "superminhash-likely")
    wanted = buckets.select("uid").distinct()
    tokens = written(rows.where("tokens is not null").select("uid", "tokens").join(wanted, "uid", "left_semi"), "superminhash-tokens")
    links = _confirmed(likely, tokens, percent)
    label = components(links)
    more = _rest(buckets, label, tokens, percent, limit)
    if more.limit(1).count():
        label = components(label.select("a", F.col("label").alias("b")).unionByName(more))
    known = sets.join(label.withColumnRenamed("a", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    heads = known.groupBy("label").agg(F.min("first").alias("component_id"))
    known = written(known.join(heads, "label").select("skey", "component_id"), "superminhash-components")
    forget(small, buckets, likely, tokens, links, more, sets)
    component = F.when(F.col("skey").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n", "skey").join(known, "skey", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that name their component."""
    keep = groups(docs, percent).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_own"))
    return rows.join(keep, F.col("_own").eqNullSafe(F.col("_id")), "left_semi").select("row.*")


def brute_force(texts: list[tuple[int, str | None]], percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(doc_id, n_shingles, component_id) by comparing all pairs; for tests."""
    words = [tokens_of((t or "").encode("utf-8", "surrogatepass")) for _, t in texts]
    sets = [{tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set() for w in words]
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(texts):
        least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(texts)]
