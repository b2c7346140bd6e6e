"""Shared-folder tables: how the operators cut lineage without tying data to one machine."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``.

    Only where that setting is absent on a local master (tests, notebooks on
    one machine) a temporary folder is made and removed at exit; on a cluster,
    whose machines would not share it, RuntimeError is raised.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, _ROOTS[app], True)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(_ROOTS[app])
    return _ROOTS[app]


_OPEN: set[str] = set()


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path for one table, in this application's own part of the shared folder, which is deleted at exit."""
    own = f"{shared_dir(spark)}/pathloom/{spark.sparkContext.applicationId}"
    if own not in _OPEN:
        _OPEN.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, own: str) -> None:
    try:
        drop_table(spark, own)
    except Exception:  # noqa: BLE001 - the session ended first
        shutil.rmtree(own.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def release_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application now. Results not yet written can no longer be read."""
    own = f"{shared_dir(spark)}/pathloom/{spark.sparkContext.applicationId}"
    drop_table(spark, own)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table outlives lost executors and starts a new, short lineage.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df_or_path) -> None:
    """Delete a table written by :func:`materialize` once nothing reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
