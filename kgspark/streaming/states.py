"""Jobs and workers with keyed state and event-time timers: what a stream knows of each job, and which workers fell silent.

Both processors keep one small state a key in the state store (RocksDB, which Spark's arbitrary state needs; `read_to_end` selects it for its run). Entries that come later than the
watermark are dropped by Spark, repeated entries within it by their event_id, and a replayed batch overwrites its own folder, so replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window as W

from kgspark.store import shared_folder

JOB = "source_id string, document_url string, status string, ts timestamp, event_id long"
#: kind: register, assign (of batch_id with its docs), heartbeat, complete (of batch_id).
WORKER_LOG = "worker_id string, ts timestamp, event_id long, kind string, batch_id string, docs array<string>"
DEAD = "worker_id string, batch_id string, dead_at timestamp, document_url string"


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(span: str) -> int:
    import pandas as pd

    return int(pd.Timedelta(span).total_seconds() * 1_000_000)


class JobStates(StatefulProcessor):
    """The state of a job: success is sticky, else the last status by (at, event_id), at in microseconds; forgotten `keep` microseconds after its last entry."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.job = handle.getValueState("job", "status string, at long, event_id long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
        import pandas as pd

        old = self.job.get()
        old = now = None if old is None else tuple(old)
        for pdf in rows:
            for status, at, event in zip(pdf["status"].tolist(), pdf["at"].tolist(), pdf["event_id"].tolist(), strict=True):
                won = now is not None and now[0] == "success"
                if now is None or (at, event) > now[1:]:
                    now = ("success" if won else status, at, event)
                elif status == "success" and not won:
                    now = ("success", *now[1:])
        if now == old:
            return
        if old is not None:
            self.handle.deleteTimer(self._end(old[1]))
        self.handle.registerTimer(self._end(now[1]))
        self.job.update(now)
        yield pd.DataFrame({"source_id": [key[0]], "document_url": [key[1]], "status": [now[0]], "at": [now[1]], "event_id": [now[2]]})

    def _end(self, at: int) -> int:
        return (at + self.keep) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: ANN001, N802, N803
        self.job.clear()
        return iter([])

    def close(self) -> None:
        pass


def job_updates(log: DataFrame, late: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """A stream of JOB rows: the new state of a job whenever entries of log (source_id, document_url, status, ts, event_id) change it. Run it in append mode."""
    once = log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    rows = once.select("source_id", "document_url", "status", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"))
    schema = "source_id string, document_url string, status string, at long, event_id long"
    got = rows.groupBy("source_id", "document_url").transformWithStateInPandas(JobStates(_micros(keep)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return got.select("source_id", "document_url", "status", F.timestamp_micros("at").alias("ts"), "event_id")


def keep_updates(updates: DataFrame, out: str, checkpoint: str):  # noqa: ANN201
    """Writes each batch's updates to a folder of its own below out; a replayed batch overwrites it."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return updates.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_table(spark: SparkSession, out: str) -> DataFrame:
    """The jobs as they stand: the last update of each, which is that of the last batch; a batch changes a job at most once."""
    rows = spark.read.schema(f"{JOB}, batch long").parquet(out)
    return rows.groupBy("source_id", "document_url").agg(F.max_by("status", "batch").alias("status"))


class Silence(StatefulProcessor):
    """A worker's batch, open documents and last sign of life, times in microseconds. Entries wait until the watermark has passed them and are then taken in order, so what comes late but in time changes nothing.

    They wait by spans of time, in parts as they came, so that one span of a worker is held in memory at a time and not all that waits.
    """

    SPAN = 3_600_000_000

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.worker = handle.getValueState("worker", "batch_id string, seen long, docs array<string>")
        self.parts = handle.getValueState("parts", "n long")
        self.waiting = handle.getMapState("waiting", "span long, part long", "entries array<struct<at: long, event_id: long, kind: string, batch_id: string, docs: array<string>>>")

    def _wait(self, entries: list) -> None:
        """Puts entries down as one part for each span that they are in."""
        n = (self.parts.get() or (0,))[0]
        spans: dict[int, list] = {}
        for e in entries:
            spans.setdefault(e[0] // self.SPAN, []).append(e)
        for span, some in spans.items():
            self.waiting.updateValue((span, n), (some,))
        self.parts.update((n + 1,))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
        first = None
        for pdf in rows:
            cols = (pdf[c].tolist() for c in ("at", "event_id", "kind", "batch_id", "docs"))
            some = [(at, event, kind, batch, [] if docs is None else [str(d) for d in docs]) for at, event, kind, batch, docs in zip(*cols, strict=True)]
            if some:
                self._wait(some)
                first = min([e[0] for e in some] if first is None else [first, *(e[0] for e in some)])
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)  # when the watermark has passed the first of them
        return iter([])

    def _due(self, now: int) -> Iterator[list]:
        """Entries before now, in order, a span at a time; what else is in a span that now lies in waits on."""
        spans: dict[int, list] = {}
        for span, part in self.waiting.keys():
            spans.setdefault(span, []).append(part)
        for span in sorted(spans):
            if span * self.SPAN >= now:
                self.handle.registerTimer(span * self.SPAN // 1000 + 1)
                return
            every = [tuple(e) for part in spans[span] for e in self.waiting.getValue((span, part))[0]]
            due = sorted((e for e in every if e[0] < now), key=lambda e: e[:2])
            if due:
                for part in spans[span]:
                    self.waiting.removeKey((span, part))
            if rest := [e for e in every if e[0] >= now]:
                if due:
                    self._wait(rest)
                self.handle.registerTimer(min(e[0] for e in rest) // 1000 + 1)
                yield due
                return
            yield due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: ANN001, N802, N803
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000  # all that it has passed is there
        columns = ["worker_id", "batch_id", "at", "document_url"]
        state, dead = self.worker.get(), []

        def silent(at: int) -> bool:
            if state is not None and at - state[1] > self.silence:
                dead.extend((key[0], state[0], state[1] + self.silence, d) for d in state[2])
                return True
            return False

        for due in self._due(now):
            for at, _, kind, batch, docs in due:
                if silent(at):
                    state = None
                if kind == "assign":
                    state = (batch, at, list(docs))
                elif kind == "register" or (kind == "complete" and state is not None and state[0] == batch):
                    state = None
                elif kind == "heartbeat" and state is not None:
                    state = (state[0], at, list(state[2]))
            if dead:
                yield pd.DataFrame(dead, columns=columns)
                dead = []
        if silent(now):
            state = None
        if state is None:
            self.worker.clear()
        else:
            self.worker.update((state[0], state[1], list(state[2])))
            self.handle.registerTimer((state[1] + self.silence) // 1000 + 1)
        if dead:
            yield pd.DataFrame(dead, columns=columns)

    def close(self) -> None:
        pass


def silent_workers(log: DataFrame, silence: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """A stream of DEAD rows: each open document of a worker that was silent for longer than `silence` while it had a batch, once. Run it in append mode.

    A worker is heard by its assignments and heartbeats. Once dead it stays so until it is assigned a batch anew; what it still says of the lost batch is ignored. Idle workers
    needn't be heard. The documents are to be queued again, all of the batch: doing one twice is harmless.
    """
    once = log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    rows = once.select("worker_id", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), "kind", "batch_id", "docs")
    schema = "worker_id string, batch_id string, at long, document_url string"
    got = rows.groupBy("worker_id").transformWithStateInPandas(Silence(_micros(silence)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return got.select("worker_id", "batch_id", F.timestamp_micros("at").alias("dead_at"), "document_url")


def silent_workers_at(log: DataFrame, as_of: Column, silence: str = "30 seconds") -> DataFrame:
    """The same DEAD rows of a whole log in batch, with the silences that have ended or outlasted by as_of.

    A spell runs from an assignment to the worker's next assignment or registration, or to the batch's completion; its first gap of more than `silence` kills it.
    """
    own = W.partitionBy("worker_id").orderBy("ts", "event_id")
    wait = F.expr(f"interval {silence}")
    rows = log.withColumn("_spell", F.sum(F.col("kind").isin("assign", "register").cast("long")).over(own))
    first = F.when(F.col("kind") == "assign", F.col("batch_id"))
    rows = rows.withColumn("_batch", F.first(first, ignorenulls=True).over(W.partitionBy("worker_id", "_spell").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    done = (F.col("kind") == "complete") & (F.col("batch_id") == F.col("_batch"))
    starts = F.col("kind").isin("assign", "register")
    rows = rows.where(F.col("kind").isin("assign", "register", "heartbeat") | done).withColumn("_done", done)
    inside = W.partitionBy("worker_id", "_spell").orderBy("ts", "event_id")
    ended = F.coalesce(F.max("_done").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_next", F.coalesce(F.lead("ts").over(own), as_of)).withColumn("_over", ended | F.col("_done"))
    gaps = rows.where(F.col("_batch").isNotNull() & ~F.col("_over") & (F.col("_next") - F.col("ts") > wait))
    dead = gaps.groupBy("worker_id", "_spell", F.col("_batch").alias("batch_id")).agg(F.min(F.col("ts") + wait).alias("dead_at"))
    docs = rows.where(starts & (F.col("kind") == "assign")).select("worker_id", "_spell", F.explode("docs").alias("document_url"))
    return dead.join(docs, ["worker_id", "_spell"]).select("worker_id", "batch_id", "dead_at", "document_url")


def read_to_end(updates: DataFrame, name: str) -> str:
    """Runs a stream of updates to the present end of its input; the folder below which each batch has its own."""
    spark = updates.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKS)
    try:
        out = shared_folder(spark, name)
        keep_updates(updates, out, shared_folder(spark, f"{name}-checkpoint")).awaitTermination()
    finally:
        spark.conf.unset(provider) if old is None else spark.conf.set(provider, old)
    return out


def job_states_by_stream(log: DataFrame, late: str = "1 hour", keep: str = "36500 days") -> DataFrame:
    """(source_id, document_url, status) of a log stream that is read to its present end by `job_updates`."""
    return job_table(log.sparkSession, read_to_end(job_updates(log, late, keep), "job-updates"))


def silent_workers_by_stream(log: DataFrame, silence: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """DEAD rows of a worker log stream that is read to its present end: silences that its watermark has seen out."""
    found = log.sparkSession.read.schema(f"{DEAD}, batch long").parquet(read_to_end(silent_workers(log, silence, late), "silent-workers"))
    return found.drop("batch")
