"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one in local mode (tests) where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once what was read from them is itself written."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of this session; every fan-out below is a multiple of it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Exchange ``rows`` rows at a time with Python in this session, unless it has a setting of its own.

    Texts and their ids are wide: the default of 10,000 rows keeps tens of megabytes in each buffer between Spark and Python.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


@contextmanager
def light_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Within: a batch between Spark and Python is cut at about ``size`` bytes; afterwards the session is as before.

    It holds for what is written within, as a plan takes the setting when it is made. A session's own limit of the kind is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = int(spark.conf.get(name).rstrip("bB"))
    spark.conf.set(name, min(size, before) if before > 0 else size)
    try:
        yield
    finally:
        spark.conf.set(name, before)
