"""Intermediate tables in a folder that every executor sees."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a single machine and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="siftgrid-")
    return _own[context.applicationId]


class Scratch:
    """Written tables of one job. `drop` deletes one, `clear` all; what is left goes when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self._at_end)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again: its lineage ends there, and a lost executor takes nothing with it."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def clear(self) -> None:
        self.drop()
        atexit.unregister(self._at_end)

    def _at_end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self.drop()
