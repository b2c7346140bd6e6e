"""Scans and journals as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import truncate_name
from ..operators.changefeed import is_metafile, map_attributes
from ..session import materialize

SCAN = "frn LONG, parent_frn LONG, attrs INT, name STRING, usn LONG"


class JournalGap(Exception):
    """The journal no longer holds the records after the cursor: scan the volume again."""


def read_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SCAN).format(fmt).load(path)


def scan_entries(records: DataFrame, volumes: DataFrame, vol: int, snapshot_usn: int | None = None, first_id: int = 0) -> DataFrame:
    """Entries of a scan: newer records left to the journal, one name per key, metafiles below the root dropped.

    Hard links: the first name by position (or by name) stands for its key.
    Ids follow the key order, so that repeated scans number alike.
    """
    root = volumes.where(F.col("vol") == vol).select(F.lit(vol).alias("vol"), "root_frn")
    kept = records if snapshot_usn is None else records.where(F.col("usn").isNull() | (F.col("usn") <= snapshot_usn))
    one = kept.groupBy("frn").agg(F.min_by(F.struct("parent_frn", "name", "attrs"), F.struct("usn", "name")).alias("r"))
    rows = one.withColumn("vol", F.lit(vol)).join(root, "vol")
    rows = rows.where(~is_metafile(F.col("r.name"), F.col("r.parent_frn"), F.col("root_frn")))
    rows = rows.select("vol", "frn", F.col("r.parent_frn").alias("parent_frn"), truncate_name(F.col("r.name")).alias("name"), map_attributes(F.col("r.attrs")).alias("flags"))
    return with_ids(rows, "frn", first_id)


def with_ids(rows: DataFrame, key: str, first_id: int = 0) -> DataFrame:
    """Adds dense entry_id in the order of ``key``, by range partitions and their counts; no global window."""
    spark = rows.sparkSession
    placed = materialize(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    starts, at = [], first_id
    for part, count in sizes:
        starts.append((part, at))
        at += count
    table = spark.createDataFrame(starts or [(0, first_id)], "__part int, __start long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return placed.withColumn("__row", within).join(F.broadcast(table), "__part").withColumn("entry_id", F.col("__start") + F.col("__row")).drop("__part", "__start", "__row")


def check_journal(first_usn: int, journal_id: int, cursor_usn: int, cursor_journal_id: int) -> None:
    """Raise :class:`JournalGap` if the journal was recreated or wrapped past the cursor."""
    if journal_id != cursor_journal_id or first_usn > cursor_usn:
        raise JournalGap("the journal does not continue from the cursor")


def journal_gaps(journal: DataFrame, volumes: DataFrame, journal_ids: dict[int, int] | None = None) -> DataFrame:
    """Per volume with records: vol, first_usn, next_usn (the cursor) and gap: the journal no longer reaches back to the cursor, or is another one.

    ``journal_ids`` has the ids found now, where they are known.
    """
    first = journal.where("vol is not null and usn is not null").groupBy("vol").agg(F.min("usn").alias("first_usn"))
    cursor = volumes.where("vol is not null").groupBy("vol").agg(F.max("next_usn").alias("next_usn"), F.max_by("journal_id", "next_usn").alias("__id"))
    changed = F.lit(False)
    for vol, found in (journal_ids or {}).items():
        changed = changed | ((F.col("vol") == vol) & (F.col("__id") != found))
    return first.join(cursor, "vol").select("vol", "first_usn", "next_usn", ((F.col("first_usn") > F.col("next_usn")) | changed).alias("gap"))


def resync(journal: DataFrame, volumes: DataFrame, rescan, journal_ids: dict[int, int] | None = None) -> list[int]:
    """Scan every volume anew whose journal has a gap: ``rescan(vol)`` swaps the new rows in. The number of volumes bounds what is collected."""
    broken = sorted(r["vol"] for r in journal_gaps(journal, volumes, journal_ids).where("gap").select("vol").collect())
    for vol in broken:
        rescan(vol)
    return broken


def folder_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, size, modified_ms) of the files below a real folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.select(
        F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1).alias("path"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("modified_ms"))
