"""Intermediate tables that cut lineage.

A table is written once as Parquet under ``spark.checkpoint.dir``, the folder
that driver and executors share, and read back. Unlike a local checkpoint it
survives the loss of any executor. Where the setting is absent, a local master
(tests on one machine) gets a folder below the system's temporary folder; on a
cluster that is an error, since executors don't share such folders.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Bytes of a row group of these tables.
ROW_GROUP = 8 << 20
_written: list[tuple[object, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder; set only where the session names none."""
    at = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{_KEY} must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set(_KEY, at)
    return at.rstrip("/")


def fewer_files(df: DataFrame) -> DataFrame:
    """``df``, which lies behind a shuffle, in at most four partitions a core if there are no more than 64 a core now.

    So a write makes few files (a local file system starts a process for each),
    and a task takes at most sixteen shuffle partitions, one after another.
    """
    spark = df.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, 2)
    return df.coalesce(4 * cores) if int(spark.conf.get("spark.sql.shuffle.partitions")) <= 64 * cores else df


def cut(df: DataFrame, label: str = "table", compact: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back, so later jobs start from the files.

    ``compact`` is for narrow tables behind a shuffle: at most as many files as
    the cluster has cores, instead of one for each shuffle partition.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    if compact:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, 2))
    # small row groups: what a writer holds back counts for each running task
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what :func:`cut` wrote, once nothing that is still to run reads it."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if getattr(spark.sparkContext, "_jsc", None) is None:
            continue
        try:
            _delete(spark, path)
        except Exception:  # the session may be ending; what stays is only scratch
            return
