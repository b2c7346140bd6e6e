"""Result pages as text: plain, long, JSON lines, and a compact grouped form."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalar import join_path, utc_minute

FRAME_BYTES = 64 << 20


def plain_lines(page: DataFrame) -> DataFrame:
    """One path per row."""
    return page.select(join_path(F.col("path"), F.col("name")).alias("line"))


def long_lines(page: DataFrame) -> DataFrame:
    """``YYYY-MM-DD HH:MM``, right-aligned size and path."""
    when = F.coalesce(utc_minute(F.col("modified_ms")), F.lit("-" * 16))
    size = F.when(F.col("is_dir"), "<DIR>").otherwise(F.coalesce(F.col("size").cast("string"), F.lit("-")))
    return page.select(F.concat_ws(" ", when, F.lpad(size, 14, " "), join_path(F.col("path"), F.col("name"))).alias("line"))


def json_lines(page: DataFrame) -> DataFrame:
    return page.select(F.to_json(F.struct(*page.columns)).alias("line"))


def _shown(row: dict, details: bool) -> str:
    name = row["name"] + ("\\" if row["is_dir"] else "")
    known = [f"{row['size']} B"] if details and row.get("size") is not None else []
    if details and row.get("modified_ms") is not None:
        known.append(datetime.fromtimestamp(row["modified_ms"] / 1000, UTC).strftime("%Y-%m-%d %H:%M"))
    return f"{name} ({', '.join(known)})" if known else name


def compact_text(rows: list[dict], total: int, offset: int = 0, details: bool = False) -> str:
    """Grouped text for language-model tools: neighbouring rows of one folder share a line; ``details`` adds size and time."""
    if not rows:
        return f"0 shown of {total}"
    end = offset + len(rows)
    head = f"{offset + 1}-{end} of {total}" + (f", next offset {end}" if end < total else "")
    lines = [head]
    for folder, group in groupby(rows, key=lambda r: r["path"]):
        names = [_shown(r, details) for r in group]
        lines.append(f"{folder}: {' | '.join(names)}")
    return "\n".join(lines)


def status_text(rows: list[dict]) -> str:
    lines = [f"{r['letter']}: {r['live']} live, {r['dead']} dead, {'on' if r['enabled'] else 'off'}{'' if r['monitor'] else ', not followed'}" for r in rows]
    return "\n".join([f"{sum(r['live'] for r in rows)} live rows", *lines])


def frame(message: dict) -> bytes:
    """One newline-terminated JSON message."""
    data = json.dumps(message, ensure_ascii=False).encode() + b"\n"
    if len(data) > FRAME_BYTES:
        raise ValueError("message is too long")
    return data


def validate_search(arguments: dict) -> dict:
    """Arguments of a search tool call with defaults; ValueError names the first bad one."""
    query = arguments.get("query")
    if not isinstance(query, str):
        raise ValueError("query must be text")
    limit, offset = arguments.get("limit", 50), arguments.get("offset", 0)
    for name, value in (("limit", limit), ("offset", offset)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise ValueError(f"{name} must be a whole number")
    from .plans.search import sort_columns

    sort = arguments.get("sort", "name")
    if not isinstance(sort, str):
        raise ValueError("sort must be text")
    sort_columns(sort)
    return {"query": query, "limit": min(limit, 500), "offset": offset, "sort": sort}
