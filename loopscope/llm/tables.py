"""Input tables, the shared working folder and intermediate tables of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` under ``sf_dir``, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine does not set it (tests), a temporary folder is made and set. On a
    cluster that would be a folder of each machine's own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loopscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created."""
    return f"{shared_folder(spark)}/loopscope/{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete ``path`` on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_made: ContextVar[list[Stored] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[Stored], Stored]]:
    """Drops, at its end, all tables stored within it but those that the function it gives was called with."""
    mine, kept = [], []
    token = _made.set(mine)

    def keep(table: Stored) -> Stored:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _made.reset(token)
        for x in mine:
            if not any(x is k for k in kept):
                x.drop()
        outer = _made.get()
        if outer is not None:
            outer += kept


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Stored:
    """A DataFrame written as Parquet to the shared folder and read again.

    It cuts lineage and survives the loss of executors. ``drop`` frees the disk when no later
    plan reads it.
    """

    def __init__(self, df: DataFrame, label: str, compression: str = "snappy"):
        self.spark = df.sparkSession
        self.path = new_folder(self.spark, label)
        # What was shuffled for this table is of no use once it is written.
        with setting(self.spark, _CLEANUP, "true"):
            df.write.option("compression", compression).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        made = _made.get()
        if made is not None:
            made.append(self)

    def drop(self) -> None:
        """Free the disk; a second call does nothing."""
        drop_folder(self.spark, self.path)
