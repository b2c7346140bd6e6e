"""The searchable catalogue: newest rows with folded names, paths and path components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators.changefeed import TOMBSTONE
from ..operators.hierarchy import hierarchy
from ..session import drop_table, materialize
from ..sources.tables import newest_entries, read_table

SEP = "\\"


def build_catalog(entries: DataFrame, volumes: DataFrame, paths: bool = True) -> DataFrame:
    """One row per (vol, frn) with the columns that searches compile to.

    Always: entry_id, vol, letter, frn, parent_frn, name, flags, is_dir,
    is_live, visible, name_fold, ext_fold. With ``paths`` also place, depth,
    path, folder, path_fold, components, components_fold, parent_known.
    Superseded rows never match and are not kept. A null name is empty, and so
    is a missing extension: predicates stay two-valued and can be pushed down.
    """
    newest = newest_entries(entries, "parent_frn", "flags", "name")
    v = volumes.where("vol is not null").select("vol", "letter", "enabled").dropDuplicates(["vol"])
    rows = newest.join(v, "vol", "left")
    flags = F.coalesce("flags", F.lit(0))
    live = flags.bitwiseAND(TOMBSTONE) == 0
    name = F.coalesce("name", F.lit(""))
    base = rows.select(
        "entry_id", "vol", "letter", "frn", "parent_frn", name.alias("name"), flags.alias("flags"), scalar.has_flag(flags, 1).alias("is_dir"), live.alias("is_live"),
        (live & F.coalesce("enabled", F.lit(False))).alias("visible"), scalar.fold(name).alias("name_fold"), F.coalesce(scalar.extension(name), F.lit("")).alias("ext_fold"))
    if not paths:
        return base
    tree = hierarchy(entries, volumes).select("vol", "frn", "place", "depth", "path")
    head = F.substring(F.col("path"), F.lit(1), F.char_length("path") - F.char_length("name"))
    folder = F.when(F.char_length(head) > 3, F.regexp_replace(head, r"\\\z", "")).otherwise(head)
    parts = F.split(F.substring("path", F.lit(4), F.char_length("path")), r"\\")
    return base.join(tree, ["vol", "frn"]).withColumns({
        "folder": folder, "path_fold": scalar.fold(F.col("path")), "components": parts,
        "components_fold": F.split(scalar.fold(F.substring("path", F.lit(4), F.char_length("path"))), r"\\"),
        "parent_known": F.col("place") != "orphan",
    })


_BUILT: dict[tuple[str, str], tuple[list, DataFrame]] = {}


def _state_of(spark: SparkSession, path: str) -> list:
    """Files of a table with their sizes and times, which tell whether it was written anew."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files, out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def catalog_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of a data folder, name-sorted within volumes: built once per application, and again when the folder's files change."""
    key = (spark.sparkContext.applicationId, sf_dir)
    state = [_state_of(spark, f"{sf_dir}/{table}.parquet") for table in ("entries", "volumes")]
    if key not in _BUILT or _BUILT[key][0] != state:
        if key in _BUILT:
            drop_table(spark, _BUILT[key][1])
        built = build_catalog(read_table(spark, sf_dir, "entries"), read_table(spark, sf_dir, "volumes"))
        # Equality and prefix predicates on the folded name then prune row groups.
        _BUILT[key] = state, materialize(built.repartitionByRange("vol", "name_fold").sortWithinPartitions("vol", "name_fold"), "catalog")
    return _BUILT[key][1]
