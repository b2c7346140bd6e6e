"""Applying a change feed to a snapshot: journal rules, per-key summaries, delete vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_table, materialize

# Reason bits in order of precedence, attribute bits and the flag each sets.
RENAME_OLD, RENAME_NEW, DELETE, CREATE, HARD_LINK, CLOSE = 0x1000, 0x2000, 0x200, 0x100, 0x10000, 0x80000000
TOMBSTONE = 0x8000
ATTRIBUTE_FLAGS = {0x10: 1, 0x2: 2, 0x4: 4, 0x400: 8}

#: Largest delete-vector table, in bytes, that a reader broadcasts.
BROADCAST_BYTES = 32 << 20
BITS = 1 << 15


def classify_reason(reason: Column) -> Column:
    """rename_old, rename, delete, create, hard_link, overwrite or null, by the first bit set."""
    kinds = [("rename_old", RENAME_OLD), ("rename", RENAME_NEW), ("delete", DELETE), ("create", CREATE), ("hard_link", HARD_LINK), ("overwrite", CLOSE)]
    out = F
    for kind, bit in kinds:
        out = out.when(reason.bitwiseAND(F.lit(bit)) != 0, F.lit(kind))
    return out


def map_attributes(attrs: Column) -> Column:
    """Attribute bits to flag bits; null counts as 0."""
    out = F.lit(0)
    for bit, flag in ATTRIBUTE_FLAGS.items():
        out = out + F.when(attrs.bitwiseAND(bit) != 0, flag).otherwise(0)
    return out


def is_metafile(name: Column, parent: Column, root: Column) -> Column:
    """A ``$`` name directly below the root; never null."""
    return F.coalesce(name.startswith("$") & (parent == root), F.lit(False))


def current_records(raw_usn: DataFrame, volumes: DataFrame) -> DataFrame:
    """Records not yet in the snapshot, classified. Repeated deliveries are still in it: all that follows is idempotent.

    Records without vol, usn or frn, or of an unknown volume, say nothing and
    are left out. Columns: vol, usn, frn, parent_frn, name, flags, ts, kind,
    makes (creates an unknown key), effect (kind if not dropped).
    """
    v = volumes.where("vol is not null").groupBy("vol").agg(F.max("next_usn").alias("__next"), F.max_by("root_frn", "next_usn").alias("__root"))
    r = raw_usn.select("vol", "usn", "frn", "parent_frn", "name", map_attributes(F.col("attrs")).alias("flags"), "ts", classify_reason(F.col("reason")).alias("kind"))
    r = r.where("usn is not null and frn is not null").join(v, "vol").where("usn >= __next")
    dropped = is_metafile(F.col("name"), F.col("parent_frn"), F.col("__root"))
    return r.select(
        "vol", "usn", "frn", "parent_frn", "name", "flags", "ts", "kind",
        (F.col("kind").isin("create", "rename", "overwrite") & ~dropped).alias("makes"),
        F.when(F.col("kind").isin("delete", "overwrite") | ~dropped, F.col("kind")).alias("effect"),
    )


def fold_changes(records: DataFrame) -> DataFrame:
    """One row per (vol, frn) that stands for all its records, in usn order, against any prior state.

    The fold is an associative summary (latest and earliest record of each
    sort), so it combines before the shuffle however many records a key has,
    and neither delivery order nor repetition matters. Columns: made_usn, made
    (the first record that would create the key), set_usn, set (last create or
    rename), over_usn, over_flags (last overwrite), create_usn, delete_usn.
    """
    image = F.struct("parent_frn", "name", "flags")
    usn, effect = F.col("usn"), F.col("effect")

    def at(*kinds: str) -> Column:
        return F.when(effect.isin(*kinds), usn)

    made = F.when(F.col("makes"), usn)
    return records.groupBy("vol", "frn").agg(
        F.min(made).alias("made_usn"), F.min_by(image, made).alias("made"),
        F.max(at("create", "rename")).alias("set_usn"), F.max_by(image, at("create", "rename")).alias("set"),
        F.max(at("overwrite")).alias("over_usn"), F.max_by("flags", at("overwrite")).alias("over_flags"),
        F.max(at("create")).alias("create_usn"), F.max(at("delete")).alias("delete_usn"),
    )


#: Column types of a fold, as it is stored.
_IMAGE = "struct<parent_frn: bigint, name: string, flags: int>"
FOLD = f"made_usn long, made {_IMAGE}, set_usn long, set {_IMAGE}, over_usn long, over_flags int, create_usn long, delete_usn long"


def merge_folds() -> list[Column]:
    """Aggregates that make one fold of several folds of a key, in any order and however often each is there."""
    return [
        F.min("made_usn").alias("made_usn"), F.min_by("made", "made_usn").alias("made"),
        F.max("set_usn").alias("set_usn"), F.max_by("set", "set_usn").alias("set"),
        F.max("over_usn").alias("over_usn"), F.max_by("over_flags", "over_usn").alias("over_flags"),
        F.max("create_usn").alias("create_usn"), F.max("delete_usn").alias("delete_usn"),
    ]


def _later(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, a.isNotNull())


def apply_fold(joined: DataFrame) -> DataFrame:
    """Final image per key: a fold row joined with its prior row (entry_id null where there is none).

    Prior columns: entry_id, parent_frn, name, flags. A key that neither was
    nor comes into being gives no row. Output: vol, frn, parent_frn, name,
    flags, with the tombstone bit for deleted keys.
    """
    known = F.col("entry_id").isNotNull()
    exists = known | F.col("made_usn").isNotNull()
    start = F.when(known, F.lit(-(1 << 63)).cast("long")).otherwise(F.col("made_usn"))
    prior_dead = known & (F.coalesce("flags", F.lit(0)).bitwiseAND(TOMBSTONE) != 0)
    deleted = F.when(F.col("delete_usn") > start, F.col("delete_usn"))
    created = F.col("create_usn")
    dead = F.when(deleted.isNotNull() & _later(deleted, created), True).when(created.isNotNull(), False).otherwise(prior_dead)
    prior = F.struct("parent_frn", "name", F.coalesce("flags", F.lit(0)).bitwiseAND(0x7FFF).alias("flags"))
    named = F.when(F.col("set_usn").isNotNull(), F.col("set")).when(known, prior).otherwise(F.col("made"))
    over = F.when(F.col("over_usn") >= start, F.col("over_usn"))
    flags = F.when(over.isNotNull() & _later(over, F.col("set_usn")), F.col("over_flags")).otherwise(named["flags"])
    return joined.where(exists).select(
        "vol", "frn", named["parent_frn"].alias("parent_frn"), named["name"].alias("name"),
        F.when(dead, flags.bitwiseOR(TOMBSTONE)).otherwise(flags).cast("int").alias("flags"),
    )


@F.pandas_udf(T.ArrayType(T.LongType()))
def _superseded(kept: pd.Series, rows: pd.Series) -> pd.Series:
    """Bitmap, in words of 64 bits, of the first ``rows`` positions that are not in ``kept``; null where there is none."""
    out = []
    for bits, n in zip(kept, rows):
        on = np.frombuffer(bits, np.uint8) if bits is not None else np.zeros(BITS // 8, np.uint8)
        off = np.unpackbits(~on, bitorder="little")
        off[int(n):] = 0
        out.append(np.packbits(off, bitorder="little").view(np.int64) if off.any() else None)
    return pd.Series(out, dtype=object)


@dataclass
class DeltaTable:
    """Base files that are never rewritten, delete vectors over their rows, and the images appended since."""

    base: DataFrame
    vectors: DataFrame
    images: DataFrame
    vector_bytes: int

    def read(self) -> DataFrame:
        """The current state, one row per key, tombstones included: (vol, frn, parent_frn, name, flags)."""
        vectors = F.broadcast(self.vectors) if self.vector_bytes <= BROADCAST_BYTES else self.vectors
        bit = F.col("__pos").bitwiseAND(BITS - 1).cast("int")
        gone = F.getbit(F.get("__dead", F.shiftright(bit, 6)), bit.bitwiseAND(63)) != 0
        live = _positions(self.base).join(vectors, ["__file", "__block"], "left").where(F.col("__dead").isNull() | ~gone)
        cols = ["vol", "frn", "parent_frn", "name", "flags"]
        return live.select(*cols).unionByName(self.images.select(*cols))

    def drop(self, spark: SparkSession) -> None:
        drop_table(spark, self.vectors)
        drop_table(spark, self.images)


def _positions(base: DataFrame) -> DataFrame:
    """Rows of a Parquet scan with file id, block and position in the file."""
    meta = F.col("_metadata")
    keep = ["entry_id", "vol", "frn", "parent_frn", "name", "flags"]
    return base.select(
        *keep, F.xxhash64(meta["file_path"]).alias("__file"), meta["row_index"].alias("__pos"),
        F.shiftright(meta["row_index"], 15).alias("__block"), meta["file_path"].alias("__path"),
    )


def apply_changes(entries: DataFrame, raw_usn: DataFrame, volumes: DataFrame) -> DeltaTable:
    """Apply the journal to the snapshot files, leaving the files as they are.

    1. The journal is folded to one row per key. 2. An index of key to (file,
    position) finds, per key, the newest row; all other rows, and every row of
    a key with a new image, are superseded. 3. Their bits are set in one bitmap
    per file and 32,768 positions. 4. New images go to an appended table.

    ``entries`` must be a plain Parquet scan. Rows with null vol, frn or
    entry_id belong to no key and stay out of the state. An empty journal gives
    the newest rows alone; an empty snapshot the images alone.
    """
    scan = _positions(entries)
    index = scan.where("vol is not null and frn is not null and entry_id is not null").groupBy("vol", "frn").agg(
        F.max("entry_id").alias("entry_id"), F.max_by("__file", "entry_id").alias("__file"), F.max_by("__pos", "entry_id").alias("__pos"),
    )
    folded = fold_changes(current_records(raw_usn, volumes))
    old = folded.join(index, ["vol", "frn"], "left")
    # The prior image is fetched by its position, so a key with many old rows stays in balance. New keys have
    # no position; they are spread by their own hash, under a position that no row has.
    old = old.withColumns({"__file": F.coalesce("__file", F.xxhash64("vol", "frn")), "__pos": F.coalesce("__pos", F.lit(-1).cast("long"))})
    prior = scan.select("__file", "__pos", "parent_frn", "name", "flags")
    images = materialize(apply_fold(old.join(prior, ["__file", "__pos"], "left")), "images")

    kept = index.join(images.select("vol", "frn"), ["vol", "frn"], "left_anti")
    kept = kept.select("__file", F.shiftright("__pos", 15).alias("__block"), F.col("__pos").bitwiseAND(BITS - 1).alias("__bit"))
    kept = kept.repartition("__file", "__block").groupBy("__file", "__block").agg(F.bitmap_construct_agg("__bit").alias("__kept"))
    blocks = scan.groupBy("__file", "__block").agg(
        (F.max("__pos").bitwiseAND(BITS - 1) + 1).alias("__rows"), F.min("__path").alias("__first"), F.max("__path").alias("__last"),
    )
    vectors = blocks.join(kept, ["__file", "__block"], "left").select(
        "__file", "__block", _superseded("__kept", "__rows").alias("__dead"), (F.col("__first") != F.col("__last")).alias("__clash"),
    )
    vectors = materialize(vectors.where("__dead is not null or __clash"), "vectors")
    size = vectors.agg(F.count("*").alias("n"), F.max("__clash").alias("clash")).first()
    if size["clash"]:
        raise ValueError("two base files share a file id")
    return DeltaTable(entries, vectors.select("__file", "__block", "__dead"), images, size["n"] * BITS // 8)


def touched_state(entries: DataFrame, raw_usn: DataFrame, volumes: DataFrame) -> DataFrame:
    """Live final state of every key that a current record names: (vol, frn, parent_frn, name, flags)."""
    table = apply_changes(entries, raw_usn, volumes)
    touched = table.images.select("vol", "frn")
    return table.read().join(touched, ["vol", "frn"], "left_semi").where(F.col("flags").bitwiseAND(TOMBSTONE) == 0)


def current_state(entries: DataFrame, raw_usn: DataFrame, volumes: DataFrame) -> DataFrame:
    """Live state of all keys after the journal."""
    return apply_changes(entries, raw_usn, volumes).read().where(F.coalesce("flags", F.lit(0)).bitwiseAND(TOMBSTONE) == 0)
