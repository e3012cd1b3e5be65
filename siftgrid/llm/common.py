"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zlib

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Where that is unset, a temporary one on a single machine and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="siftgrid-")
    return _own_dir[app]


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The table goes with `done`, or when the program ends.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clear)
    _written[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """df, computed and held on the executors' disks, beside their shuffle files; what a lost executor held is computed again.

    Other than `cut` it creates no files in the shared folder. A local folder costs two processes a file (for its
    mode and its folder's), and a process that is started counts the whole memory of its executor once more for a moment.
    """
    df.persist(StorageLevel.DISK_ONLY).count()
    return df


def done(*tables: DataFrame) -> None:
    """Delete tables that `cut` or `kept` gave and that no later action reads."""
    for df in tables:
        if "cut_path" in vars(df):
            _delete(df.cut_path)
        else:
            df.unpersist()


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _clear() -> None:
    for path in list(_written):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores added as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Tables of at most so many bytes, measured, are sent whole.
SENT_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: Column) -> bool:
    """Whether the rows of df, measured, take at most SENT_BYTES. df should be a written table: the measure reads it."""
    return (df.agg(F.sum(row_bytes + 32)).first()[0] or 0) <= SENT_BYTES


def sent_whole(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df marked for broadcast if it is small; beyond that as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, row_bytes) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir; one that comes in fewer parts than there are cores is dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod `modulus`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def lower_words(text: str | None) -> list[bytes]:
    """Words of the text as UTF-8, with A-Z lower-cased and nothing else changed."""
    return text.encode().lower().split() if text else []


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def seeded(*parts: object) -> np.random.Generator:
    """A generator that depends on the parts alone, so a task that runs again draws the same numbers."""
    return np.random.default_rng(zlib.crc32("|".join(map(str, parts)).encode()))

