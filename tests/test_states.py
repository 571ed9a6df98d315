"""Keyed stream state: streamed results equal batch ones, replay changes nothing, states expire, timers fire once."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kgspark.operators import retrieval as R
from kgspark.streaming import states as S
from kgspark.streaming.jobs import table_stream

START = datetime(2024, 1, 1)


def _parts(spark, rows, schema, folder, n):
    """rows as n files of a stream, in order of arrival."""
    size = -(-len(rows) // n)
    for i in range(n):
        if part := rows[i * size : (i + 1) * size]:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))


def _log(n=300):
    deal = random.Random(1)
    rows = [(f"s{deal.randrange(3)}", f"d{deal.randrange(25)}", deal.choice(["queued", "running", "failed", "success"] if i % 3 else ["running", "failed"]), START + timedelta(minutes=i, seconds=deal.randrange(-1200, 1200)), i) for i in range(n)]
    return rows + rows[n // 2 : n // 2 + 5]  # entries delivered twice


def test_streamed_job_states_equal_batch(spark, tmp_path):
    rows = _log()
    _parts(spark, rows, S.JOB, tmp_path / "log", 6)
    stream = table_stream(spark, str(tmp_path / "log"), 1)
    want = {(r.source_id, r.document_url): r.status for r in R.job_states(spark.createDataFrame(rows, S.JOB)).collect()}
    assert {(r.source_id, r.document_url): r.status for r in S.job_states_by_stream(stream).collect()} == want
    assert "success" in want.values() and len(want) > 40


def test_late_failures_and_replayed_batches_change_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    at = lambda m: START + timedelta(minutes=m)
    first = [("s", "a", "running", at(0), 1), ("s", "a", "success", at(1), 2), ("s", "b", "running", at(2), 3)]
    _parts(spark, first, S.JOB, tmp_path / "log", 1)
    run = lambda: S.keep_updates(S.job_updates(table_stream(spark, str(tmp_path / "log"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    table = lambda: {r.document_url: r.status for r in S.job_table(spark, str(tmp_path / "out")).collect()}
    run()
    assert table() == {"a": "success", "b": "running"}
    _parts(spark, [("s", "a", "failed", at(9), 4), first[2], ("s", "b", "failed", at(10), 5)], S.JOB, tmp_path / "log", 1)
    run()
    assert table() == {"a": "success", "b": "failed"}
    newest = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if "=" in p.name)
    kept = spark.read.parquet(str(tmp_path / "out")).where(F.col("batch") == newest).drop("batch").collect()
    spark.createDataFrame(kept, S.JOB).write.mode("overwrite").parquet(str(tmp_path / f"out/batch={newest}"))  # what a replay does
    run()
    assert table() == {"a": "success", "b": "failed"}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_job_states_expire(spark, tmp_path):
    """A success is forgotten an hour after it: the failure much later starts the job anew."""
    at = lambda m: START + timedelta(minutes=m)
    rows = [("s", "a", "success", at(0), 1), ("s", "x", "running", at(600), 2), ("s", "x", "running", at(900), 3), ("s", "a", "failed", at(901), 4)]
    _parts(spark, rows, S.JOB, tmp_path / "log", 4)
    stream = lambda: table_stream(spark, str(tmp_path / "log"), 1)
    status = lambda keep: {r.document_url: r.status for r in S.job_states_by_stream(stream(), "1 minute", keep).collect()}
    assert status("1 hour")["a"] == "failed" and status("30 days")["a"] == "success"


def simulated(rows, as_of, silence):
    """(worker, batch, dead at, document) by walking each worker's entries in order."""
    out = []
    for worker in sorted({r[0] for r in rows}):
        batch = seen = None
        docs: list = []
        for _, ts, _, kind, name, held in [*sorted((r for r in rows if r[0] == worker), key=lambda r: (r[1], r[2])), (worker, as_of, 0, "end", None, None)]:
            if batch is not None and ts - seen > silence:
                out += [(worker, batch, seen + silence, d) for d in docs]
                batch = None
            if kind == "assign":
                batch, seen, docs = name, ts, held
            elif kind == "register" or (kind == "complete" and name == batch):
                batch = None
            elif kind == "heartbeat" and batch is not None:
                seen = ts
    return sorted(out)


def _workers():
    deal = random.Random(7)
    rows, last = [], {}
    for i in range(240):
        w = f"w{deal.randrange(4)}"
        kind = deal.choice(["assign", "heartbeat", "heartbeat", "heartbeat", "complete", "register"] if i % 2 else ["assign", "heartbeat"])
        batch = f"b{i}" if kind == "assign" else deal.choice([last.get(w), "other"]) if kind == "complete" else None
        last[w] = batch if kind == "assign" else last.get(w)
        rows.append((w, START + timedelta(seconds=4 * i + deal.random()), i, kind, batch, [f"d{i}", f"e{i}"] if kind == "assign" else None))
    return rows


def test_silent_workers_in_batch_and_stream(spark, tmp_path):
    rows = _workers()
    as_of, silence = max(r[1] for r in rows), timedelta(seconds=30)
    log = spark.createDataFrame(rows, S.WORKER_LOG)
    of = lambda df: sorted((r.worker_id, r.batch_id, r.dead_at, r.document_url) for r in df.collect())
    want = simulated(rows, as_of, silence)
    assert len(want) > 10
    assert of(S.silent_workers_at(log, F.lit(as_of))) == want
    shuffled = [r for i in range(0, len(rows), 6) for r in sorted(rows[i : i + 6], key=lambda r: hash(r[3]))]  # out of order by less than the watermark
    _parts(spark, shuffled, S.WORKER_LOG, tmp_path / "log", 8)
    got = of(S.silent_workers_by_stream(table_stream(spark, str(tmp_path / "log"), 1), "30 seconds", "1 minute"))
    assert got == [d for d in want if d[2] < as_of - timedelta(minutes=1)]


def test_silence_of_thirty_seconds_requeues_a_batch_once(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("w", at(0), 1, "assign", "b", ["x", "y"]), ("w", at(29), 2, "heartbeat", None, None), ("idle", at(0), 3, "register", None, None), ("w", at(70), 4, "heartbeat", None, None), ("w", at(80), 5, "complete", "b", None),
            ("other", at(400), 6, "heartbeat", None, None)]
    _parts(spark, rows, S.WORKER_LOG, tmp_path / "log", 6)
    got = S.silent_workers_by_stream(table_stream(spark, str(tmp_path / "log"), 1)).collect()
    assert sorted((r.worker_id, r.batch_id, r.dead_at, r.document_url) for r in got) == [("w", "b", at(59), "x"), ("w", "b", at(59), "y")]


def test_a_worker_holds_one_span_of_its_log_at_a_time():
    """Entries wait in the state by hours; those of all days are never read at once."""
    import pandas as pd

    class Value:
        now = None
        get = lambda self: self.now
        update = lambda self, x: setattr(self, "now", x)
        clear = lambda self: setattr(self, "now", None)

    class Map(dict):
        most = 0
        updateValue, removeKey = dict.__setitem__, dict.__delitem__  # noqa: N815

        def getValue(self, k):  # noqa: N802
            self.most = max(self.most, len(self[k][0]))
            return self[k]

    class Handle:
        def __init__(self):
            self.kept, self.timers = Map(), []

        getValueState = lambda self, *_: Value()  # noqa: E731, N815
        getMapState = lambda self, *_: self.kept  # noqa: E731, N815
        registerTimer = lambda self, at: self.timers.append(at)  # noqa: E731, N815

    class Clock:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    minute = 60_000_000
    log = [(i * minute, i, "assign" if i == 0 else "heartbeat", "b" if i == 0 else None, ["x"] if i == 0 else None) for i in range(3000) if i <= 1000 or i > 1100]
    random.Random(3).shuffle(log)
    pdf = pd.DataFrame(log, columns=["at", "event_id", "kind", "batch_id", "docs"])
    one, handle = S.Silence(30 * minute), Handle()
    one.init(handle)
    assert list(one.handleInputRows(("w",), iter([pdf[:1500], pdf[1500:]]), None)) == [] and handle.timers == [1]
    got = [tuple(r) for ms in (500 * 60_000 + 1, 2000 * 60_000, 2999 * 60_000 + 1) for d in one.handleExpiredTimer(("w",), Clock(ms), None) for r in d.values.tolist()]
    assert got == [("w", "b", 1030 * minute, "x")] and not handle.kept
    assert handle.kept.most <= 60
