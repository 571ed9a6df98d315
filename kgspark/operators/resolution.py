"""Entity resolution: names joined to the most similar earlier name that leads, as a loop in order of arrival would, in parallel rounds."""

from __future__ import annotations

from collections.abc import Callable
from math import acos

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions.text import band, cosine
from kgspark.operators.vindex import usable
from kgspark.store import forget, stored

BLOCK = 1_000  # names of a kind compared at once with as many others
PIVOTS, RINGS = 8, 16
BATCH = 20_000  # names of all kinds that are resolved at first; each later batch is as large as all before it
LEADS, BOTH, ASKS = 0, 1, 2  # names that only earlier ones may be, either, only later ones


def blocks_of(names: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """names (seq, kind, embedding) with `_block`, the block of their kind that they are in, and `_a`, their angles to the kind's pivots.

    A kind's first `pivots` names by a hash are its pivots. A name is in the cell of the nearest one, and cells of more than `block` names are cut into rings of
    angles to it, and those by a hash. So a block's names are alike, as far as pivots tell, and of one `role`, where names have that column. Names without a whole vector are left out; vectors of different lengths are of different kinds.
    """
    role, floor = (F.col(c) if c in names.columns else F.lit(v) for c, v in (("role", BOTH), ("floor", -3.0)))
    whole = names.where(usable(F.col("embedding"), F.size("embedding"))).select("seq", "kind", F.col("embedding").cast("array<double>").alias("embedding"), role.alias("_role"), floor.alias("_floor"))
    whole = whole.withColumn("_size", F.size("embedding"))
    group = ["kind", "_size"]
    first = whole.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(F.xxhash64("seq"), "seq"))).where(F.col("_n") <= pivots)
    held = first.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_n", "embedding"))).alias("_pivots"))  # `pivots` vectors
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    norm = lambda a: F.sqrt(dot(a, a))
    angle = lambda p: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(p["embedding"], F.col("embedding")) / (norm(p["embedding"]) * norm(F.col("embedding"))))))
    near = whole.join(held, group).withColumn("_a", F.transform("_pivots", angle)).drop("_pivots")
    near = near.withColumn("_cell", F.array_position("_a", F.array_min("_a")).cast("int")).withColumn("_r", F.array_min("_a"))
    cells = near.groupBy(*group, "_role", "_cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"), F.percentile_approx("_r", [i / RINGS for i in range(1, RINGS)]).alias("_cuts"))
    ring = F.size(F.filter("_cuts", lambda c: F.col("_r") > c))
    rings = F.least(F.col("_blocks"), F.lit(RINGS))
    placed = near.join(cells, [*group, "_role", "_cell"]).withColumn("_ring", F.floor(ring * rings / RINGS).cast("int"))
    sub = F.pmod(F.xxhash64("seq"), F.ceil(F.col("_blocks") / RINGS)).cast("int")
    return placed.select("seq", "kind", "_size", "embedding", "_floor", "_a", F.struct("_role", "_cell", "_ring", sub.alias("_sub")).alias("_block"))


def meeting_blocks(dealt: DataFrame, least: float, pivots: int = PIVOTS) -> DataFrame:
    """(kind, _size, a, b, n_a, n_b), a <= b: the blocks of `blocks_of` that can hold a pair of cosine `least` or more.

    Angles between vectors obey the triangle inequality, so a pair's angle is at least the difference of its angles to any pivot. Blocks whose ranges of angles to some pivot
    are farther apart than the angle of `least` hold no pair.
    """
    at = [F.get("_a", F.lit(v)) for v in range(pivots)]
    stats = dealt.groupBy("kind", "_size", "_block").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(x) for x in at]).alias("lo"), F.array(*[F.max(x) for x in at]).alias("hi"))
    side = lambda c: stats.select("kind", "_size", F.col("_block").alias(c), F.col("n").alias(f"n_{c}"), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"))
    far = F.lit(acos(max(-1.0, min(1.0, least))) + 1e-6)
    apart = F.greatest(F.array_max(F.zip_with("lo_a", "hi_b", lambda x, y: x - y)), F.array_max(F.zip_with("lo_b", "hi_a", lambda x, y: x - y)))
    meet = ~((F.col("a._role") == F.col("b._role")) & F.col("a._role").isin(LEADS, ASKS))
    return side("a").join(side("b"), ["kind", "_size"]).where(meet & (F.col("a") <= F.col("b")) & (F.coalesce(apart, F.lit(0.0)) <= far)).select("kind", "_size", "a", "b", "n_a", "n_b")


def _compared(names: DataFrame, least: float, block: int, best: bool) -> DataFrame:
    """(seq, other, sim) from every two blocks that can hold a pair; `best`: of each block pair only the most similar earlier name of each (ties: the earliest).

    Where names have a `role`, LEADS are only `other`, ASKS only `seq`; where they have a `floor`, their pairs are more similar than that.
    """
    dealt = stored(blocks_of(names, block), "resolve-blocks")
    met = stored(meeting_blocks(dealt, least).select("kind", "_size", "a", "b"), "resolve-meetings")
    rows = dealt.select("seq", "kind", "_size", "embedding", "_floor", F.col("_block._role").alias("_role"), "_block")
    one = rows.join(met.withColumn("_block", F.col("a")), ["kind", "_size", "_block"]).withColumn("left", F.lit(True))
    two = rows.join(met.where("a < b").withColumn("_block", F.col("b")), ["kind", "_size", "_block"]).withColumn("left", F.lit(False))
    seq_type = names.schema["seq"].dataType.simpleString()

    def compare(pdf):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        v = np.array(pdf["embedding"].tolist(), np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-10
        left, seq = pdf["left"].to_numpy(), pdf["seq"].to_numpy()
        if left.all():
            x, y = np.arange(len(seq)), np.arange(len(seq))
        else:
            x, y = np.flatnonzero(left), np.flatnonzero(~left)
        sims = v[x] @ v[y].T
        keep = sims >= least
        keep &= seq[x][:, None] > seq[y][None, :] if left.all() else seq[x][:, None] != seq[y][None, :]
        role, floor = pdf["_role"].to_numpy(), pdf["_floor"].to_numpy(np.float64)
        if (role != BOTH).any() or (floor > -3).any():
            i, j = np.nonzero(keep)
            swap = seq[x][i] < seq[y][j]
            late, early = np.where(swap, y[j], x[i]), np.where(swap, x[i], y[j])
            fit = (role[late] != LEADS) & (role[early] != ASKS) & (sims[i, j] > floor[late])
            keep[i[~fit], j[~fit]] = False
        i, j = np.nonzero(keep)
        out = pd.DataFrame({"seq": np.maximum(seq[x][i], seq[y][j]), "other": np.minimum(seq[x][i], seq[y][j]), "sim": sims[i, j]})
        if best:
            out = out.sort_values(["seq", "sim", "other"], ascending=[True, False, True], kind="stable").drop_duplicates("seq")
        return out

    units = one.unionByName(two).select("kind", "_size", "a", "b", "left", "seq", "embedding", "_role", "_floor")
    return units.groupBy("kind", "_size", "a", "b").applyInPandas(compare, f"seq {seq_type}, other {seq_type}, sim double")


def similar_pairs(names: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(seq, other, sim): pairs of names (seq, kind, embedding), other < seq, of one kind and cosine similarity of at least `least`.

    Exact: a kind's names are dealt to blocks around pivots; every two blocks that can hold such a pair meet in one task as matrices, so a kind of any size is compared in bounded pieces and only
    similar pairs leave. Names with a null, a zero or a broken vector are in no pair.
    """
    return _compared(names, least, block, best=False)


def best_earlier(names: DataFrame, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """For names (seq, kind, embedding): the most similar earlier name of the same kind (ties: the earliest), and its band. Each two blocks give one row a name."""
    sims = _compared(names, -2.0, block, best=True)
    best = sims.groupBy("seq").agg(F.min(F.struct((-F.col("sim")).alias("down"), "other")).alias("m"))
    return best.select("seq", F.col("m.other").alias("best"), (-F.col("m.down")).alias("sim"), band(-F.col("m.down"), low, high).alias("band"))


def resolve_banded(names: DataFrame, low: float = 0.55, high: float = 0.97, adjudicator: Callable[[DataFrame], DataFrame] | None = None, batch: int = BATCH) -> DataFrame:
    """(seq, leader, decision) of names (seq, kind, embedding[, name]) as in a loop in order of seq.

    A name's best match is the most similar earlier leader of its kind (ties: the earliest). At `high` or above it joins it (auto_merge); below `low`, or without one, it leads
    (new); between them the adjudicator is asked about that pair alone: it takes (seq, other, sim) and adds a boolean `same` (adjudicated_merge, adjudicated_new); without one
    the name leads (unadjudicated). Blank names pass through (blank) and are no match for others. Names that have been registered before are rows of lower seq.

    Names are taken in batches in order of seq. A batch is compared with the leaders before it, of which only the best of each name counts, and then among itself: with those of its names that may lead, and for pairs more
    similar than that best. So names that have joined earlier are met no more, and the work grows with names times leaders. In a batch each round decides the names whose best leader
    beats all undecided candidates, and knows as no leaders those that have a leader at `high` or above. So the result is that of the loop. Rounds are written tables.
    """
    blank = F.trim("name") == "" if "name" in names.columns else F.lit(False)
    live = stored(names.where(~F.coalesce(blank, F.lit(True))).select("seq", "kind", "embedding"), "resolve-names")
    out = stored(names.where(F.coalesce(blank, F.lit(True))).select("seq", F.col("seq").alias("leader"), F.lit("blank").alias("decision")), "resolve-done")
    cuts, leaders = _cuts(live, batch), None
    for low_cut, high_cut in zip([None, *cuts], [*cuts, None], strict=True):
        part = live if low_cut is None else live.where(F.col("seq") > low_cut)
        part = part if high_cut is None else part.where(F.col("seq") <= high_cut)
        if leaders is None:
            pairs = stored(similar_pairs(part, low).withColumn("led", F.lit(False)), "resolve-pairs")
        else:
            met = _compared(leaders.withColumn("role", F.lit(LEADS)).unionByName(part.withColumn("role", F.lit(ASKS))), low, BLOCK, best=True)
            old = stored(met.groupBy("seq").agg(F.min(F.struct((-F.col("sim")).alias("down"), "other")).alias("m")).select("seq", F.col("m.other").alias("other"), (-F.col("m.down")).alias("sim")), "resolve-old")
            floor = part.join(old.select("seq", F.col("sim").alias("floor")), "seq", "left").withColumn("floor", F.coalesce("floor", F.lit(-3.0))).where(F.col("floor") < 1 - 1e-9)
            among = _compared(floor.withColumn("role", F.when(F.col("floor") < high, BOTH).otherwise(ASKS)), low, BLOCK, best=False)
            pairs = stored(among.withColumn("led", F.lit(False)).unionByName(old.withColumn("led", F.lit(True))), "resolve-pairs")
            forget(old)
        got = _rounds(part, pairs, high, adjudicator)
        forget(pairs)
        out = out.unionByName(got)
        if high_cut is not None:
            more = live.join(got.where("leader = seq").select("seq"), "seq", "left_semi")
            last, leaders = leaders, stored(more if leaders is None else leaders.unionByName(more), "resolve-leaders")
            if last is not None:
                forget(last)
    if leaders is not None:
        forget(leaders)
    return out


def _cuts(names: DataFrame, batch: int) -> list:
    """The last seq of each batch but the last: of `batch` names, then of as many as came before."""
    n, shares = names.count(), []
    while batch < n:
        shares.append(batch / n)
        batch *= 2
    return sorted(set(names.agg(F.percentile_approx("seq", shares)).first()[0])) if shares else []


def _rounds(names: DataFrame, pairs: DataFrame, high: float, adjudicator: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(seq, leader, decision) of names, whose candidates are pairs (seq, other, sim, led): `led` ones are leaders, the others are of names."""
    waiting, done, joining = stored(names.select("seq"), "resolve-waiting"), None, None
    kind = pairs.schema["other"].dataType
    while waiting.limit(1).count():
        state, its, known = pairs.join(waiting, "seq"), F.lit(None).cast(kind), F.lit(False)
        if done is not None:
            told = done.select(F.col("seq").alias("other"), F.col("leader").alias("its")).unionByName(joining.select(F.col("seq").alias("other"), F.lit(None).cast(kind).alias("its")))
            state, its, known = state.join(told.withColumn("known", F.lit(True)), "other", "left"), F.col("its"), F.coalesce("known", F.lit(False))
        at, leads = F.struct((-F.col("sim")).alias("down"), "other"), F.coalesce(F.col("led") | (its == F.col("other")), F.lit(False))
        first = state.groupBy("seq").agg(F.min(F.when(leads, at)).alias("best"), F.min(F.when(~leads & ~known, at)).alias("open"))
        first = stored(waiting.join(first, "seq", "left").select("seq", "best", F.coalesce(F.col("open").isNull() | (F.col("best") < F.col("open")), F.lit(False)).alias("sure")), "resolve-first")
        more = first.where(~F.col("sure") & (-F.col("best.down") >= high)).select("seq")
        ready = stored(first.where("sure").select("seq", F.col("best.other").alias("other"), (-F.col("best.down")).alias("sim")), "resolve-ready")
        asked = ready.where(F.col("other").isNotNull() & (F.col("sim") < high))
        if adjudicator is None:
            judged = asked.select("seq", F.lit(False).alias("same"))
        else:
            judged = adjudicator(asked.select("seq", "other", "sim")).select("seq", "same")
        got = ready.join(judged, "seq", "left")
        same = F.coalesce("same", F.lit(False))
        decision = (
            F.when(F.col("other").isNull(), "new").when(F.col("sim") >= high, "auto_merge").when(F.lit(adjudicator is None), "unadjudicated")
            .when(same, "adjudicated_merge").otherwise("adjudicated_new")
        )
        got = got.select("seq", F.when((F.col("sim") >= high) | same, F.col("other")).otherwise(F.col("seq")).alias("leader"), decision.alias("decision"))
        old = [x for x in (waiting, done, joining, ready, first) if x is not None]
        joining = stored(more, "resolve-joining")
        done = stored(got if done is None else done.unionByName(got), "resolve-done")
        waiting = stored(waiting.join(done, "seq", "left_anti"), "resolve-waiting")
        forget(*old)
    forget(waiting, *([joining] if joining is not None else []))
    return done if done is not None else names.select("seq", F.col("seq").alias("leader"), F.lit("new").alias("decision"))


def resolve(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(seq, leader): the single-threshold form; a name joins its best match at or above the threshold, else it leads."""
    return resolve_banded(names, threshold, threshold).select("seq", "leader")


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def decide_pairs(pairs: DataFrame, low: float = 0.55, high: float = 0.97, adjudicator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(pair_id, sim, band, same) of pairs (pair_id, a, b: vectors): one entity or two, without a registry."""
    sims = pairs.select("pair_id", cosine(F.col("a"), F.col("b")).alias("sim"))
    sims = sims.withColumn("band", band(F.col("sim"), low, high))
    if adjudicator is None:
        return sims.withColumn("same", F.col("band") == "merge")
    judged = adjudicator(sims.where("band = 'borderline'").select("pair_id", "sim")).select("pair_id", F.col("same").alias("_same"))
    return sims.join(judged, "pair_id", "left").select("pair_id", "sim", "band", ((F.col("band") == "merge") | F.coalesce("_same", F.lit(False))).alias("same"))
