"""Following a change journal with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changefeed import FOLD, apply_fold, current_records, fold_changes, merge_folds
from ..sources.scan import resync
from ..sources.tables import SCHEMAS

STATE = ["vol", "frn", "parent_frn", "name", "flags"]


class StateTable:
    """State below ``root`` as a base and one small delta per micro-batch: the folds of the keys it touched.

    Base and deltas keep the usns of the folds beside the image in the
    snapshot (``prior``, null where there is none), and folds merge in any
    order, so a record that comes late or again in a later batch counts at its
    usn. Keys that are not made yet are kept too: their first record may still
    come. A batch that runs again overwrites its own delta. Folders written
    without usns cannot be read; their journal must be followed anew.
    """

    def __init__(self, spark: SparkSession, root: str, initial: DataFrame):
        self.spark, self.root = spark, root.rstrip("/")
        fold = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.DataType.fromDDL(FOLD)]
        prior = F.struct("parent_frn", "name", "flags").alias("prior")
        self.base, self.base_version = initial.select("vol", "frn", prior, F.lit(False).alias("touched"), *fold), -1

    def _folds(self, version: int, keys: DataFrame | None = None) -> DataFrame:
        """One merged fold per key; ``touched`` where a record of it has come."""
        rows = self.base
        for v in range(self.base_version + 1, version + 1):
            rows = rows.unionByName(self.spark.read.schema(self.base.schema).parquet(f"{self.root}/batch={v}"))
        if keys is not None:
            rows = rows.join(keys, ["vol", "frn"], "left_semi")
        return rows.groupBy("vol", "frn").agg(F.max("prior").alias("prior"), F.max("touched").alias("touched"), *merge_folds())

    def read(self, version: int, keys: DataFrame | None = None) -> DataFrame:
        """State after a batch, or only its rows of ``keys``: these are cut out before folds are merged."""
        folds = self._folds(version, keys)
        image = [F.col("prior")[c].alias(c) for c in STATE[2:]]
        still = folds.where(~F.col("touched")).select("vol", "frn", *image)
        known = F.when(F.col("prior").isNotNull(), F.lit(0).cast("long")).alias("entry_id")
        return apply_fold(folds.where("touched").select("*", known, *image)).unionByName(still)

    def write(self, folds: DataFrame, version: int) -> None:
        prior = F.lit(None).cast(self.base.schema["prior"].dataType).alias("prior")
        folds.select("*", prior, F.lit(True).alias("touched")).select(*self.base.columns).write.mode("overwrite").parquet(f"{self.root}/batch={version}")

    def compact(self, version: int) -> None:
        """Merge the deltas up to a version into a new base; tombstones stay."""
        path = f"{self.root}/base={version}"
        self._folds(version).write.mode("overwrite").parquet(path)
        self.base, self.base_version = self.spark.read.schema(self.base.schema).parquet(path), version


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def step(batch: DataFrame, volumes: DataFrame) -> DataFrame:
    """Folds of the keys that one batch touches; they hold against any state, so none is read. Tombstones are kept for good."""
    return fold_changes(current_records(batch, volumes))


def follow(
    spark: SparkSession, journal_dir: str, table: StateTable, volumes: DataFrame, checkpoint: str, interval: str | None = None, files_per_batch: int = 10, compact_every: int = 100, rescan=None,
):
    """Start the tail: all that is there now (``interval`` None) or a poll every ``interval`` (such as ``750 milliseconds``).

    Records may come in any order and repeatedly, within a batch and across
    batches. After a restart the checkpoint continues; a repeated batch gives
    the same delta. Volumes with ``monitor`` false are not followed. With
    ``rescan``, given where the folder already holds the start of the journal,
    volumes whose journal has a gap are scanned anew before a first tail
    (:func:`pathloom.sources.scan.resync`).
    """
    if rescan is not None and not _exists(spark, checkpoint):
        resync(spark.read.schema(SCHEMAS["raw_usn"]).parquet(journal_dir), volumes, rescan)
    watched = volumes.where(F.coalesce("monitor", F.lit(True)))
    source = spark.readStream.schema(SCHEMAS["raw_usn"]).option("maxFilesPerTrigger", files_per_batch).parquet(journal_dir)

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.write(step(batch, watched), batch_id)
        if batch_id - table.base_version >= compact_every:
            table.compact(batch_id)

    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
