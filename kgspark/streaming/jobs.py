"""Streaming forms of ingestion and of the job log: the same results as the batch operators over what has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.commits import GRAPH_KEYS, commit


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet folder as a stream of its files, with the schema that it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(arrivals: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):  # noqa: ANN201
    """Applies `step` to each micro-batch and keeps its rows below `out`; each batch has a folder of its own that a replay overwrites."""

    def write(batch: DataFrame, n: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_tables(arrivals: DataFrame, step: Callable[[DataFrame], dict[str, DataFrame]], root: str, name: str, checkpoint: str, keys: dict[str, list[str]] = GRAPH_KEYS):  # noqa: ANN201
    """Commits what `step` makes of each micro-batch, all its tables at once, below `root`: a batch that is replayed after a failure changes nothing, and readers never see half of one."""

    def write(batch: DataFrame, n: int) -> None:
        commit(batch.sparkSession, root, f"{name}-{n}", step(batch), keys)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failed(log: DataFrame, most_chars: int = 500) -> DataFrame:
    """The dead letters of a log, streamed or not: failed entries, with their error cut to its length."""
    return log.where("status = 'failed'").withColumn("error", F.substring(F.coalesce("error", F.lit("")), 1, most_chars))


def failures_by_hour(log: DataFrame) -> DataFrame:
    """(hour, failures) of a log (ts, status) in batch: what `failures_by_window` gives of a whole stream."""
    return log.where("status = 'failed'").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("failures"))


def failures_by_window(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, failures): failed entries of log(ts, status) in tumbling windows; entries later than `late` are left out of a closed window."""
    failed = log.where("status = 'failed'").withWatermark("ts", late)
    return failed.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("failures")).select(F.col("w.start").alias("start"), "failures")


def stuck_at(log: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """(source_id, document_url) of a log, streamed or not, whose last status is running and older than `minutes` at as_of: run with `latest`, each trigger lists the jobs stuck by then."""
    from kgspark.operators.retrieval import stuck

    return stuck(log, as_of, minutes)


def latest(result: DataFrame, out: str, checkpoint: str):  # noqa: ANN201
    """Runs an aggregation over all that has arrived and keeps its whole result of each batch, written by executors, in a folder of its own."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_batch(spark: SparkSession, out: str, schema) -> DataFrame:  # noqa: ANN001
    """The rows of the newest batch that `latest` has kept; none if there is no batch."""
    try:
        rows = spark.read.parquet(out)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], schema)
        raise
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == newest).drop("batch")
