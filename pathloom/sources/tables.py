"""Explicit schemas and readers of the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SCHEMAS = {
    "volumes": "vol INT, letter STRING, guid BINARY, journal_id LONG, next_usn LONG, root_frn LONG, enabled BOOLEAN, monitor BOOLEAN",
    "entries": "entry_id LONG, vol INT, frn LONG, parent_frn LONG, name STRING, flags INT, seen_at TIMESTAMP_NTZ",
    "raw_usn": "vol INT, usn LONG, frn LONG, parent_frn LONG, ts TIMESTAMP_NTZ, reason LONG, attrs INT, name STRING, arrived_at TIMESTAMP_NTZ",
    "hits": "hit_id LONG, client_id LONG, name STRING, path STRING, is_dir BOOLEAN, size LONG, modified_ms LONG, created_ms LONG",
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, thread_id LONG, parent_id LONG, author STRING, posted_at TIMESTAMP_NTZ",
    "eval_items": "item_id LONG, text STRING, lang STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a table may be one Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def newest_entries(entries: DataFrame, *columns: str) -> DataFrame:
    """One row per (vol, frn): the given columns of the row with the highest entry_id.

    ``max_by`` on fixed-width columns keeps its buffer in the hash map of the
    aggregation; with text among them, all columns travel as one struct, which
    moves names once, where fetching them by entry_id would move them three
    times. Repeated rows collapse before the shuffle either way. Rows without
    vol, frn or entry_id name no node and are left out.
    """
    keyed = entries.where("vol is not null and frn is not null and entry_id is not null").groupBy("vol", "frn")
    kinds = dict(entries.dtypes)
    if any(kinds[c] in ("string", "binary") for c in columns):
        newest = keyed.agg(F.max("entry_id").alias("entry_id"), F.max_by(F.struct(*columns), "entry_id").alias("__row"))
        return newest.select("vol", "frn", "entry_id", *[F.col("__row")[c].alias(c) for c in columns])
    return keyed.agg(F.max("entry_id").alias("entry_id"), *[F.max_by(c, "entry_id").alias(c) for c in columns])
