"""Tables written between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings while tables are written: what their queries shuffled is not needed again, and batches of a few thousand rows keep both sides of
#: the pipe to Python small. They change no result. A session of its own for writing would have Python workers of its own, which take
#: too much of an executor's memory beside the others.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

#: How many tables are being written, and the settings that the first writer found; the last one puts them back.
_lock = threading.Lock()
_writing: dict[str, tuple[int, dict[str, str | None]]] = {}

#: Folders written and not deleted yet, with the session and the thread that wrote them.
_made: dict[str, tuple[SparkSession, int]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and everything runs in one process, as in
    local tests, one of our own; on a cluster its absence is an error, as other executors could not read what one writes."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "webloom-shared")


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """WHILE_WRITING for as long as any thread writes in this session."""
    own = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writing.get(own) or (0, {name: spark.conf.get(name, None) for name in WHILE_WRITING})
        _writing[own] = (n + 1, before)
        for name, value in WHILE_WRITING.items():
            spark.conf.set(name, value)
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(own)
            if n > 1:
                _writing[own] = (n - 1, before)
            else:
                for name, value in before.items():
                    if value is None:
                        spark.conf.unset(name)
                    else:
                        spark.conf.set(name, value)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, for what Spark writes there itself; it goes at the end of the process, or with ``scratch``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made[path] = (spark, threading.get_ident())
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and losing an executor costs
    no more than the tasks that ran on it. Folders are unique, so a repeated run never reads a half-written one. ``discard`` deletes
    the table once nothing reads it any more; what is left goes at the end of the process."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with _settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(path: str) -> None:
    spark, _ = _made.pop(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path in _made:
            _delete(path)


@contextmanager
def scratch(keep: list[DataFrame]) -> Iterator[None]:
    """Delete, at the end, all tables that this thread wrote inside, but for those that ``keep`` has by then."""
    own = threading.get_ident()
    before = set(_made)
    try:
        yield
    finally:
        kept = {getattr(df, "stored_at", None) for df in keep}
        for path in [p for p, (_, thread) in list(_made.items()) if thread == own and p not in before and p not in kept]:
            _delete(path)


@atexit.register
def discard_all() -> None:
    """Delete all tables that are left."""
    for path in list(_made):
        try:
            _delete(path)
        except Exception:  # the session may have gone before; then only a local folder can still be reached
            _made.pop(path, None)
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
