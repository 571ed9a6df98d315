"""An inverted-file index of vectors: approximate nearest passages without a scan of all of them. Exact search (`retrieval.vector_topk`) stays the default.

`build_index` fits centroids on a bounded sample (spherical k-means), deals every row to the list of its nearest centroid and writes the lists as a table partitioned by list.
How many lists a query has to probe is measured when the index is built: queries from the sample are answered exactly over the sample, and the number of probes is
the least at which the wanted share of their true neighbours lies in the lists probed. `search_index` reads the lists that any query probes and no others; each list meets its queries in
blocks of rows and of queries, and each block keeps the best k, so a list of any size and any number of queries are taken in bounded pieces.

Defined cases: null and zero vectors, and vectors with a null in them or of another length than most, are not indexed (`build_index` counts them); such queries find nothing; fewer than k rows are returned where the probed lists hold
fewer; ties go to the least id; an empty table gives an index without lists.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from kgspark.store import shared_folder

SAMPLE, QUERIES, ROUNDS = 20_000, 500, 12  # rows that centroids are fitted on, of them queries that probes are measured with, rounds of k-means
BLOCK = 20_000  # rows of a list, and queries, that meet at once


@dataclass
class Index:
    """Where the lists are, their centroids (unit vectors; lists x dimensions floats, on the driver), and the probes that reach the recall asked for."""

    path: str
    centroids: list[list[float]]
    probes: int
    skipped: int

    def save(self, spark: SparkSession) -> None:
        spark.createDataFrame([(json.dumps(self.__dict__),)], "index string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(**json.loads(spark.read.schema("index string").parquet(f"{path}/about").first()[0]))


def usable(vector: Column, size: Column | int) -> Column:
    """Whether a vector is whole, of the wanted size and not zero."""
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return F.coalesce((F.size(vector) == size) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(m):  # noqa: ANN001, ANN202
    import numpy as np

    return m / np.linalg.norm(m, axis=1, keepdims=True)


def kmeans(v, n: int, rounds: int = ROUNDS, seed: int = 7):  # noqa: ANN001, ANN201
    """n unit centroids of unit vectors; an empty list takes the vector that is farthest from its own."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), min(n, len(v)), replace=False)]
    for _ in range(rounds):
        sims = v @ c.T
        own = sims.argmax(1)
        new = np.zeros_like(c)
        np.add.at(new, own, v)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        if len(empty):
            new[empty] = v[np.argsort(sims.max(1), kind="stable")[: len(empty)]]
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 0, new / np.maximum(norm, 1e-30), c)
    return c


def probes_for(v, c, k: int, recall: float, queries: int = QUERIES) -> int:  # noqa: ANN001
    """The least number of nearest lists in which at least `recall` of the k nearest sampled vectors of sampled queries lie."""
    import numpy as np

    q = v[:: max(1, len(v) // queries)]
    own = (v @ c.T).argmax(1)
    near = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)  # of each list, for each query
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def build_index(chunks: DataFrame, n_lists: int | None = None, k: int = 8, recall: float = 0.95, sample: int = SAMPLE, path: str | None = None) -> Index:
    """Writes the lists of chunks (id, embedding). n_lists: by default the root of the number of rows, at most one for each 16 sampled rows."""
    import numpy as np

    spark = chunks.sparkSession
    path = path or shared_folder(spark, "vector-index")
    usual = chunks.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = usual.d if usual else 0
    rows = chunks.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(usable(F.col("embedding"), size))
    total, n = rows.count(), good.count()
    share = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, n))))
    held = good.where(share).select("id", "embedding").orderBy(F.xxhash64("id", F.lit(6)), "id").limit(2 * sample).collect()  # about `sample` rows
    if not held:
        index = Index(path, [], 0, total - n)
        index.save(spark)
        return index
    v = _unit(np.array([r.embedding for r in held]))
    lists = n_lists or int(min(max(1, n**0.5), max(1, len(v) // 16)))
    c = kmeans(v, lists)
    index = Index(path, c.tolist(), probes_for(v, c, k, recall), total - n)
    dealt = good.mapInPandas(_assigner(spark, index, 1, "id", "embedding"), T.StructType([chunks.schema["id"], T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType())]))
    blocks = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # a row a list
    placed = dealt.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    placed.repartition("list", "block").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    index.save(spark)
    return index


def _assigner(spark: SparkSession, index: Index, probes: int, key: str, vector: str):  # noqa: ANN202
    """A function of batches that adds the `probes` nearest lists of each row, a row each."""
    held = spark.sparkContext.broadcast(index.centroids)  # lists x dimensions, of a bounded sample

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        c = np.array(held.value)
        for pdf in batches:
            for at in range(0, len(pdf), 8192):
                part = pdf.iloc[at : at + 8192]
                sims = _unit(np.array(part[vector].tolist(), np.float64)) @ c.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                out = part.loc[part.index.repeat(near.shape[1]), [key, vector]]
                yield out.assign(list=near.ravel().astype(np.int32))

    return run


def search_index(spark: SparkSession, index: Index, queries: DataFrame, k: int = 8, probes: int | None = None) -> DataFrame:
    """(qid, id, distance, rank): of the lists nearest to each query (qid, vector), its k nearest rows by cosine distance, ties by id."""
    lists = spark.read.parquet(f"{index.path}/lists") if index.centroids else None
    id_type = lists.schema["id"].dataType if lists is not None else T.LongType()
    if lists is None:
        return spark.createDataFrame([], T.StructType([queries.schema["qid"], T.StructField("id", id_type), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    own = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector"), len(index.centroids[0])))
    asked = own.mapInPandas(_assigner(spark, index, probes or index.probes, "qid", "vector"), T.StructType([queries.schema["qid"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType())]))
    sizes = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_blocks"))  # a row a list
    blocks = spark.read.parquet(f"{index.path}/lists").select("list", "block").distinct()
    # Every block of a list's queries meets every block of its rows.
    left = asked.join(F.broadcast(sizes), "list").withColumn("q_block", F.pmod(F.xxhash64("qid"), F.col("q_blocks")).cast("int")).join(blocks, "list")
    right = lists.join(F.broadcast(sizes), "list").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    unit = ["list", "block", "q_block"]
    schema = T.StructType([queries.schema["qid"], T.StructField("id", id_type), T.StructField("distance", T.DoubleType())])

    def nearest(q, r):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        order = np.argsort(r["id"].to_numpy(), kind="stable")
        ids = r["id"].to_numpy()[order]
        if q.empty or r.empty:
            return pd.DataFrame({"qid": q["qid"].iloc[:0], "id": r["id"].iloc[:0], "distance": pd.Series([], dtype=float)})
        v, got = _unit(np.array(r["embedding"].tolist(), np.float64)[order]), []
        for at in range(0, len(q), 1024):
            part = q.iloc[at : at + 1024]
            d = 1 - _unit(np.array(part["vector"].tolist(), np.float64)) @ v.T
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            got.append(pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()}))
        return pd.concat(got)

    met = left.select(*unit, "qid", "vector").groupBy(*unit).cogroup(right.select(*unit, "id", "embedding").groupBy(*unit))
    near = met.applyInPandas(nearest, schema)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("distance", "id"))).where(F.col("rank") <= k)


def recall_at(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): over the queries of exact (qid, id), the share of its rows that found has too."""
    hits = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(F.countDistinct("qid").alias("queries"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
