"""Ordered, paged searches with an exact total."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..query.ast import Node
from ..query.compiler import compile_node
from ..query.parser import parse

#: Most matches that a time order accepts when a guard is wanted.
TIME_SORT_LIMIT = 200_000


#: Largest page that is broadcast to its metadata.
PAGE_LIMIT = 10_000
#: Rows of a page where the caller names none, and the most he may name: here, on the command line, for tools, in a window, in a window by time.
PAGE_DEFAULTS = {"core": (1000, None), "cli": (100, None), "tool": (50, 500), "window": (1000, None), "window_by_time": (10_000, None)}


class SearchRefused(Exception):
    """A time-ordered search over too many matches."""


def sort_columns(sort: str) -> list[Column]:
    """Order of a sort name: name, path, modified, created, each with a leading ``-`` for descending, or an alias.

    Name and path orders reverse in full; time orders keep nulls last and ties ascending in both directions.
    """
    sort = ALIASES.get(sort.lower(), sort.lower())
    back, key = sort.startswith("-"), sort.lstrip("-")
    if key in ("name", "path"):
        cols = ["name_fold" if key == "name" else "path", "entry_id"]
        return [F.col(c).desc() if back else F.col(c).asc() for c in cols]
    if key in ("modified", "created"):
        c = F.col(f"{key}_ms")
        return [c.desc_nulls_last() if back else c.asc_nulls_last(), F.col("entry_id").asc()]
    raise ValueError(f"unknown sort: {sort}")


ALIASES = {
    "name_desc": "-name", "path_desc": "-path", "date": "modified", "mtime": "modified", "-date": "-modified", "-mtime": "-modified", "modified_desc": "-modified",
    "date_modified": "modified", "ctime": "created", "-ctime": "-created", "created_desc": "-created", "date_created": "created", "newest": "-modified", "oldest": "modified", "newest_created": "-created", "oldest_created": "created",
}


def folder_resolver(catalog: DataFrame):
    """Looks a folder path up once, case-insensitively; trailing separators and ``/`` are accepted."""

    def resolve(folder: str) -> tuple[int, int] | None:
        path = folder.rstrip("\\/").replace("/", "\\")
        path = path + "\\" if len(path) == 2 else path
        row = catalog.where("is_live and is_dir").where(F.col("path_fold") == path.lower()).orderBy("entry_id").select("vol", "frn").first()
        return (row["vol"], row["frn"]) if row else None

    return resolve


def matches(catalog: DataFrame, query: str | Node) -> DataFrame:
    """All visible rows that match, unordered."""
    node = parse(query) if isinstance(query, str) else query
    return catalog.where("visible").where(compile_node(node, folder_resolver(catalog)))


def enrich(rows: DataFrame, metadata: DataFrame, page: bool = False) -> DataFrame:
    """Adds size, modified_ms and created_ms by (folder, name), null where nothing is known.

    ``metadata``: path, name and the three columns; of repeated rows any one
    serves, as they agree. For a ``page``, which its limit bounds, only metadata
    of its keys is grouped, and both sides stay where they are.
    """
    if page:  # ordered once: its few rows come to the driver, where they are bound anyway
        rows = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
        keys = rows.select(F.col("folder").alias("path"), "name").distinct()
        metadata = metadata.join(F.broadcast(keys), ["path", "name"], "left_semi")
    m = metadata.where("path is not null and name is not null").groupBy(F.col("path").alias("folder"), "name").agg(
        *[F.max(c).alias(c) for c in ("size", "modified_ms", "created_ms")])
    return rows.join(F.broadcast(m) if page else m, ["folder", "name"], "left")


@dataclass
class Result:
    """A page (with its position in the order) and the exact total of all matches."""

    page: DataFrame
    total: int
    hits: DataFrame


def page_of(rows: DataFrame, sort: str, limit: int, offset: int) -> DataFrame:
    """``limit`` rows (0: all) from ``offset`` with their position; planned as a top-k, not a full sort."""
    ordered = rows.orderBy(*sort_columns(sort))
    page = ordered.offset(offset) if offset else ordered
    page = page.limit(limit) if limit else page
    # The page is at most ``limit`` rows, so one task numbers it; an unlimited page carries no number.
    if limit:
        page = page.withColumn("position", F.row_number().over(Window.orderBy(*sort_columns(sort))) + F.lit(offset))
    return page


def hit_rows(page: DataFrame, drop_unknown: bool = True) -> DataFrame:
    """Rows as shown. Those without a known parent are dropped only here, after counting and paging."""
    keep = [c for c in ("position", "entry_id", "name", "folder", "is_dir", "size", "modified_ms", "created_ms") if c in page.columns]
    page = page.where("parent_known") if drop_unknown else page
    return page.select(*keep).withColumnRenamed("folder", "path")


def search(catalog: DataFrame, query: str, limit: int = 1000, offset: int = 0, sort: str = "name", metadata: DataFrame | None = None, guard: bool = False) -> Result:
    """Search with total. Metadata is joined to the page, or before ordering where the order needs it."""
    found = matches(catalog, query)
    by_time = sort.lstrip("-") not in ("name", "path") and ALIASES.get(sort.lower(), sort).lstrip("-") not in ("name", "path")
    if by_time and metadata is None:
        raise ValueError("a time order needs metadata")
    total = found.count()
    if by_time and guard and total > TIME_SORT_LIMIT:
        raise SearchRefused(f"{total} matches are too many to order by time")
    rows = enrich(found, metadata) if by_time else found
    page = page_of(rows, sort, limit, offset)
    if metadata is not None and not by_time:
        page = enrich(page, metadata, page=0 < limit <= PAGE_LIMIT)
    return Result(hit_rows(page, not by_time), total, found)


def with_path_filter(query: str, folder: str) -> str:
    """The query with a ``path:`` term in front; an empty folder changes nothing."""
    return " ".join(part for part in (folder.strip() and f"path:{folder.strip()}", query.strip()) if part)


def highlight(name: str, query: str) -> list[tuple[int, int]]:
    """Merged character ranges of a shown name that the query's text terms cover."""
    from ..query.ast import Contains, Not, Whole

    def terms(node: Node):
        if isinstance(node, Not):
            return
        if isinstance(node, (Contains, Whole)):
            yield node
        for c in node.children():
            yield from terms(c)

    ranges = []
    for t in terms(parse(query)):
        hay, needle = (name, t.text) if t.case else (name.lower(), t.text.lower())
        at = hay.find(needle) if needle else -1
        while at >= 0:
            ranges.append((at, at + len(needle)))
            at = hay.find(needle, at + 1)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged
