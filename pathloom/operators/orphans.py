"""References to records that are missing, deleted, or made only later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import newest_entries
from .asof import asof_before
from .balance import balanced_join
from .changefeed import TOMBSTONE, current_records

#: Keys per block: runs end at block borders, so as-of matching never needs a whole volume in one task.
KEY_BLOCK_BITS = 16
#: Journal positions per block of a folder's timeline.
USN_BLOCK = 1 << 24


def key_runs(keys: DataFrame) -> DataFrame:
    """Distinct integer keys (vol, key) compressed into contiguous runs (vol, block, start, end)."""
    block = F.shiftright("key", KEY_BLOCK_BITS)
    order = F.row_number().over(Window.partitionBy("vol", "block").orderBy("key"))
    runs = keys.select("vol", "key", block.alias("block")).withColumn("island", F.col("key") - order)
    return runs.groupBy("vol", "block", "island").agg(F.min("key").alias("start"), F.max("key").alias("end")).drop("island")


def beyond_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """Keys of ``refs`` (vol, key; distinct) that no run covers: the run starting last at or before them ends too early."""
    asked = refs.select("vol", F.shiftright("key", KEY_BLOCK_BITS).alias("block"), F.col("key").alias("at"), F.lit(None).cast("long").alias("end"), F.lit(1).alias("asks"))
    have = runs.select("vol", "block", F.col("start").alias("at"), "end", F.lit(0).alias("asks"))
    preceding = Window.partitionBy("vol", "block").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    matched = asked.unionByName(have).withColumn("reach", F.last("end", True).over(preceding))
    return matched.where((F.col("asks") == 1) & (F.col("reach").isNull() | (F.col("at") > F.col("reach")))).select("vol", F.col("at").alias("key"))


def orphan_references(entries: DataFrame, raw_usn: DataFrame, volumes: DataFrame) -> DataFrame:
    """Every reference to a parent that does not live: (tab, vol, row_key, kind, day).

    ``entries``: live newest rows against the newest row of their parent.
    ``raw_usn``: distinct records not yet in the snapshot against the parent's
    state just before them. Kinds: deleted, late (made by a later record),
    missing. A null parent is no reference; a null day stays null; rows without
    vol, frn, entry_id or usn are not references of any record.

    Keys that live throughout are compressed to runs and references as-of
    matched against them. What lies beyond the run is settled exactly: by the
    key's own row for entries, by its timeline of creates and deletes for
    records. Hot parents are split over tasks.
    """
    state = materialize(newest_entries(entries, "parent_frn", "flags", "seen_at"), "newest")
    dead = F.coalesce("flags", F.lit(0)).bitwiseAND(TOMBSTONE) != 0
    records = current_records(raw_usn, volumes)
    usn, effect = F.col("usn"), F.col("effect")
    changed = records.groupBy("vol", "frn").agg(
        F.min(F.when(F.col("makes"), usn)).alias("made"), F.max(F.when(effect == "delete", usn)).alias("deleted"),
    ).where("made is not null or deleted is not null")
    changed = materialize(changed, "changed")

    steady = state.where(~dead).join(changed.where("deleted is not null"), ["vol", "frn"], "left_anti")
    runs = key_runs(steady.select("vol", F.col("frn").alias("key")))
    from_entries = state.where(~dead & F.col("parent_frn").isNotNull()).select(
        F.lit("entries").alias("tab"), "vol", F.col("parent_frn").alias("key"), F.col("entry_id").alias("row_key"), F.col("seen_at").cast("date").alias("day"))
    from_records = records.where("parent_frn is not null").select(
        F.lit("raw_usn").alias("tab"), "vol", F.col("parent_frn").alias("key"), F.col("usn").alias("row_key"), F.col("ts").cast("date").alias("day"))
    refs = from_entries.unionByName(from_records)
    doubtful = beyond_runs(refs.select("vol", "key").distinct(), runs)
    facts = doubtful.join(state.select("vol", F.col("frn").alias("key"), F.when(dead, "dead").otherwise("live").alias("was")), ["vol", "key"], "left")
    facts = facts.join(changed.withColumnRenamed("frn", "key"), ["vol", "key"], "left")
    facts = materialize(facts.select("vol", "key", F.coalesce("was", F.lit("absent")).alias("was"), "made", "deleted"), "doubtful")

    open_refs = balanced_join(refs, facts, ["vol", "key"], ["row_key"])
    by_row = F.when(F.col("was") == "dead", "deleted").when(F.col("was") == "absent", F.when(F.col("made").isNotNull(), "late").otherwise("missing"))
    e = open_refs.where("tab = 'entries'").withColumn("kind", by_row)

    r = open_refs.where("tab = 'raw_usn'")
    # Creates and deletes of doubtful keys that count: a delete before the key exists does nothing.
    turns = records.where(effect.isin("create", "delete")).select("vol", F.col("frn").alias("key"), "usn", effect.alias("turn"))
    turns = turns.join(facts.where("deleted is not null or was = 'dead'"), ["vol", "key"]).where("was != 'absent' or usn > made or turn = 'create'")
    turns = turns.select("vol", "key", F.col("usn").alias("row_key"), "turn")
    timed = asof_before(r, turns, ["vol", "key"], "row_key", "turn", USN_BLOCK)
    unborn = (F.col("was") == "absent") & (F.col("made").isNull() | (F.col("made") >= F.col("row_key")))
    then = F.when(unborn, F.when(F.col("made") > F.col("row_key"), "late").otherwise("missing"))
    then = then.when((F.col("turn") == "delete") | (F.col("turn").isNull() & (F.col("was") == "dead")), "deleted")
    r = timed.withColumn("kind", then)

    cols = ["tab", "vol", "row_key", "kind", "day"]
    found = e.select(*cols).unionByName(r.select(*cols)).where("kind is not null")
    return found.groupBy("tab", "vol", "row_key", "kind").agg(F.max("day").alias("day"))


def orphans_by_day(entries: DataFrame, raw_usn: DataFrame, volumes: DataFrame) -> DataFrame:
    """References counted per table, day (null days apart) and kind."""
    return orphan_references(entries, raw_usn, volumes).groupBy("tab", "day", "kind").agg(F.count("*").alias("n"))
