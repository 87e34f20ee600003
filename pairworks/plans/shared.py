"""Tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_to_delete: ContextVar[list[str] | None] = ContextVar("_to_delete", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may go without it."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pairworks-")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/pairworks/{label}-{uuid.uuid4().hex}"
    if (within := _to_delete.get()) is not None:
        within.append(path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators stored on the way inside it, in this thread.

    For work that ends with a write: frames that are still to be computed may read those tables.
    """
    paths: list[str] = []
    token = _to_delete.set(paths)
    try:
        yield
    finally:
        _to_delete.reset(token)
        for path in paths:
            delete_folder(spark, path)


def materialise(df: DataFrame, label: str, broadcast_rows: int = 0) -> DataFrame:
    """`df` written once as Parquet and read back.

    Lineage ends here, so a lost executor costs a re-read and not a re-run, and from the file
    sizes Spark knows how big the table is: it broadcasts the table in a later join if it is
    below spark.sql.autoBroadcastJoinThreshold and uses a sort-merge join if it is not.
    Tables of a few numbers per row may be worth a broadcast beyond that threshold: with
    `broadcast_rows` the rows are counted, and up to that many are marked for it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    if broadcast_rows and stored.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return F.broadcast(stored)
    return stored
