"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh one only for unset local sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.conf.get("spark.app.id", "")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="outcome-risk-")
    return _local_roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path, in the folder of the run that is open, if one is."""
    folder = _folder.get() or f"{shared_root(spark)}/outcome_risk"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


class Run:
    """The tables that one analysis stores, in a folder that can be given back."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/outcome_risk/{label}-{uuid.uuid4().hex}"

    @contextmanager
    def open(self) -> Iterator[Run]:
        """What is stored meanwhile goes to the run's folder."""
        token = _folder.set(self.path)
        try:
            yield self
        finally:
            _folder.reset(token)

    def release(self) -> None:
        """Delete the run's tables; results that read them cannot be used any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: lineage is cut and Catalyst knows the true size.

    Because file sizes feed the join planner, a table written here is broadcast
    only when its measured size is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
