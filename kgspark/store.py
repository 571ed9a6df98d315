"""Written tables in the cluster's shared folder: they cut lineage, survive lost executors and are deleted when used up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets a temporary one and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_open: ContextVar[list[DataFrame] | None] = ContextVar("_open", default=None)


@contextmanager
def tables_until_written() -> Iterator[list[DataFrame]]:
    """Deletes at its end, also after an error, what `stored` wrote within it: for callers that write a query's result inside and then need none of its tables."""
    tables: list[DataFrame] = []
    before = _open.set(tables)
    try:
        yield tables
    finally:
        _open.reset(before)
        forget(*tables)


def stored(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got.stored_at = path
    if (tables := _open.get()) is not None:
        tables.append(got)
    return got


def unsent(df: DataFrame) -> DataFrame:
    """df, not broadcast by the join it is in. Spark judges written tables by their compressed size, which for numbered or repeated values is a small part of what the driver would hold of them."""
    return df.hint("merge")


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote and nothing reads any more."""
    for t in tables:
        if path := getattr(t, "stored_at", None):
            jvm = t.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
