"""Driver queries of the search language and of the catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import render
from .engine import status
from .functions import scalar
from .operators.changefeed import classify_reason, current_records, is_metafile, map_attributes
from .operators.hierarchy import hierarchy
from .plans.catalog import build_catalog, catalog_of
from .plans.search import enrich, hit_rows, matches, page_of
from .query.parser import parse, reusable
from .session import new_table_path
from .sources.scan import journal_gaps
from .sources.snapshot import SnapshotStore
from .sources.tables import newest_entries, read_table as t

NEWEST = """newest as (select vol, frn, max(entry_id) entry_id, arg_max_null(parent_frn, entry_id) p, coalesce(arg_max_null(name, entry_id), '') as name,
  coalesce(arg_max_null(flags, entry_id), 0) flags from entries group by 1, 2)"""
TREE = rf"""{NEWEST},
up as (select n.*, v.letter, v.enabled, coalesce(n.frn = v.root_frn, false) is_root, case when n.frn = v.root_frn then null else n.p end pp from newest n left join volumes v on n.vol = v.vol),
edge as (select u.* from up u join newest n on u.vol = n.vol and u.pp = n.frn),
tree as (select vol, frn, coalesce(letter, '?') || ':\' || case when is_root then '' else name end path, 0 depth, case when is_root then 'root' else 'orphan' end place, frn top
    from up u where not exists (select 1 from edge e where e.vol = u.vol and e.frn = u.frn)
  union all select e.vol, e.frn, g.path || case when g.place = 'root' then '' else '\' end || e.name, g.depth + 1, case when g.place in ('root', 'in') then 'in' else 'in_orphan' end, g.top
    from tree g join edge e on e.vol = g.vol and e.pp = g.frn),
cat as (select u.entry_id, u.vol, u.letter, u.frn, u.p, u.name, u.flags, u.flags & 1 <> 0 is_dir, u.flags & 32768 = 0 live, u.flags & 32768 = 0 and u.enabled visible,
    lower(u.name) nf, nullif(regexp_extract(lower(u.name), '\.([^.\\/]+)$', 1), '') ext, coalesce(g.path, u.name) path, lower(coalesce(g.path, u.name)) pf, g.depth,
    coalesce(g.place, 'circle') place, g.top from up u left join tree g on u.vol = g.vol and u.frn = g.frn),
shown as (select *, case when length(head) > 3 then regexp_replace(head, '\\$', '') else head end folder from (select *, left(path, length(path) - length(name)) head from cat where visible))"""
CAT = f"with recursive {TREE}"
META = "meta as (select path mp, name mn, max(size) size, max(modified_ms) modified_ms, max(created_ms) created_ms from hits where path is not null and name is not null group by 1, 2)"
PARTS = r"string_split(substring(pf, 4), '\')"

# One search for each predicate and operator: key -> (search, the same condition in SQL).
SEARCHES = {
    "pred_all": ("", "true"),
    "pred_word": ("report", "contains(nf, 'report')"),
    "pred_word_unicode": ("отчёт", "contains(nf, 'отчёт')"),
    "pred_case": ("case:IMG", "contains(name, 'IMG')"),
    "pred_phrase": ('"copy of"', "contains(nf, 'copy of')"),
    "pred_phrase_literal": ('"report (4)"', "contains(nf, 'report (4)')"),
    "pred_glob_suffix": ("*.log", "ends_with(nf, '.log')"),
    "pred_glob_affix": ("report*.txt", "starts_with(nf, 'report') and ends_with(nf, '.txt') and length(nf) >= 10"),
    "pred_glob_question": ("config*v??.pdf", "regexp_full_match(nf, 'config.*v..\\.pdf')"),
    "pred_glob_stars": ("***", "true"),
    "pred_whole_name": ("wfn:work", "nf = 'work'"),
    "pred_whole_case": ("case:wfn:work", "name = 'work'"),
    "pred_whole_glob": ("wfn:img_*.jpg", "starts_with(nf, 'img_') and ends_with(nf, '.jpg')"),
    "pred_regex": (r"regex:^[a-c].*\.txt$", r"regexp_matches(name, '(?i)^[a-c].*\.txt$')"),
    "pred_regex_case": (r"case:regex:^[A-C].*\.(txt|pdf)$", r"regexp_matches(name, '^[A-C].*\.(txt|pdf)$')"),
    "pred_regex_shape": (r"regex:\.json$", "ends_with(nf, '.json')"),
    "pred_regex_literal": ("regex:(4", "contains(nf, '(4')"),
    "pred_regex_named": (r"regex:^(?P<stem>report)_(?<n>\d+)", r"regexp_matches(name, '(?i)^report_\d+')"),
    "pred_regex_class": ("regex:^[a-z&&[^aeiou]]{3}", "regexp_matches(name, '(?i)^[b-df-hj-np-tv-z]{3}')"),
    "pred_regex_script": (r"regex:^\p{Cyrillic}{3}", r"regexp_matches(name, '^\p{Cyrillic}{3}')"),
    "pred_regex_bad": ("regex:(5{,3} | regex:(5", "contains(nf, '(5{,3}') or contains(nf, '(5')"),
    "pred_regex_repeat": ("regex:e++s", "regexp_matches(name, '(?i)e+s')"),
    "pred_ext": ("ext:.PDF,docx;xml", "ext in ('pdf', 'docx', 'xml')"),
    "pred_macro": ("image:", "ext in ('avif','bmp','gif','heic','ico','jpeg','jpg','png','psd','raw','svg','tif','tiff','webp')"),
    "pred_macro_rest": ("exe:old", "ext in ('bat','cmd','com','exe','msi','ps1','scr') and contains(nf, 'old')"),
    "pred_folder": ("folder:", "is_dir"),
    "pred_file_rest": ("file:archive", "not is_dir and contains(nf, 'archive')"),
    "pred_path_part": ("path:tools", f"len(list_filter({PARTS}, lambda x: contains(x, 'tools'))) > 0"),
    "pred_path_full": (r"path:common\pool", r"contains(pf, 'common\pool')"),
    "pred_path_slash": ("path:common/pool | letter", "contains(pf, 'common/pool') or contains(nf, 'letter')"),
    "pred_drive": ("d:", r"contains(pf, 'd:\')"),
    "pred_drive_folder": ("e:/work/objects", r"contains(pf, 'e:\work\objects')"),
    "pred_drive_case": (r"case:C:\tools", r"contains(path, 'C:\tools')"),
    "pred_parent": (r"parent:c:\tools", r"exists (select 1 from cat f where f.live and f.is_dir and f.pf = 'c:\tools' and f.vol = c.vol and f.frn = c.p and c.frn <> f.frn)"),
    "pred_parent_root": ("parent:D:", r"exists (select 1 from cat f where f.pf = 'd:\' and f.vol = c.vol and f.frn = c.p and c.frn <> f.frn)"),
    "pred_parent_unknown": (r"parent:C:\nowhere | letter", "contains(nf, 'letter')"),
    "pred_unknown_prefix": ("!zip2:x report", "not contains(nf, 'zip2:x') and contains(nf, 'report')"),
    "bool_and": ("report v1", "contains(nf, 'report') and contains(nf, 'v1')"),
    "bool_or": ("invoice | letter ext:pdf", "contains(nf, 'invoice') or (contains(nf, 'letter') and ext = 'pdf')"),
    "bool_not": ("!ext:dll config", "coalesce(ext <> 'dll', true) and contains(nf, 'config')"),
    "bool_lone_bang": ("backup | !", "contains(nf, 'backup') or contains(nf, '!')"),
    "bool_too_deep": ("(" * 80 + "backup" + ")" * 80 + " v1", "contains(nf, 'backup') and contains(nf, 'v1')"),
    "bool_groups": ("(scan | <draft img) file:", "(contains(nf, 'scan') or (contains(nf, 'draft') and contains(nf, 'img'))) and not is_dir"),
    "bool_stray_closer": ("notes | draft ) v1", "(contains(nf, 'notes') or contains(nf, 'draft')) and contains(nf, 'v1')"),
    "bool_regex_marks": ("(regex:^(old|new)_) txt", "regexp_matches(name, '(?i)^(old|new)_') and contains(nf, 'txt')"),
    "bool_empty_functions": ("ext: path: regex: wfn: case: parent: thumbs", "contains(nf, 'thumbs')"),
    "bool_ext_or": ("ext:jpg|png", "ext = 'jpg' or contains(nf, 'png')"),
}

# The canned searches of the published workload.
BENCH = ["a", "e", "win", "dll", "ext:exe", "ext:rs;toml", "readme", "path:program", "*.log", "folder:temp", "!ext:dll sys", "config|settings", r"regex:^[a-c].*\.txt$", "case:Windows",
         "wfn:notepad.exe", "x", "node_modules", "ext:png;jpg;gif", '"program files"', "cache"]
BENCH_SQL = ["contains(nf, 'a')", "contains(nf, 'e')", "contains(nf, 'win')", "contains(nf, 'dll')", "ext = 'exe'", "ext in ('rs', 'toml')", "contains(nf, 'readme')",
             f"len(list_filter({PARTS}, lambda x: contains(x, 'program'))) > 0", "ends_with(nf, '.log')", "is_dir and contains(nf, 'temp')", "coalesce(ext <> 'dll', true) and contains(nf, 'sys')",
             "contains(nf, 'config') or contains(nf, 'settings')", r"regexp_matches(name, '(?i)^[a-c].*\.txt$')", "contains(name, 'Windows')", "nf = 'notepad.exe'", "contains(nf, 'x')",
             "contains(nf, 'node_modules')", "ext in ('png', 'jpg', 'gif')", "contains(nf, 'program files')", "contains(nf, 'cache')"]


def _searcher(text: str):
    return lambda spark, d: matches(catalog_of(spark, d), text).select("entry_id", "name")


def _page(text: str, sort: str, limit: int, offset: int = 0):
    """A page with its positions, as ``search`` builds it."""

    def run(spark, d):
        found, timed = matches(catalog_of(spark, d), text), sort.lstrip("-") in ("modified", "created")
        meta = t(spark, d, "hits")
        page = page_of(enrich(found, meta) if timed else found, sort, limit, offset)
        return hit_rows(page if timed else enrich(page, meta, page=True), not timed)

    return run


def _page_sql(where: str, order: str, limit: int, offset: int = 0, timed: bool = False) -> str:
    keep = "true" if timed else "place <> 'orphan'"
    return f"""{CAT}, {META}, hit as (select *, row_number() over (order by {order}) pos from shown c left join meta on folder = mp and name = mn where {where})
      select pos::int "position", entry_id, name, folder as path, is_dir, size, modified_ms, created_ms from hit where pos > {offset} and pos <= {offset + limit} and {keep}"""


def bench_totals(spark, d):
    """Exact totals of the canned searches, in one pass over the catalogue."""
    from .plans.search import folder_resolver
    from .query.compiler import compile_node

    catalog = catalog_of(spark, d)
    resolve = folder_resolver(catalog)
    counts = [F.count_if(compile_node(parse(q), resolve)).alias(f"q{i:02d}") for i, q in enumerate(BENCH)]
    return catalog.where("visible").agg(*counts)


def narrowing(spark, d):
    """A longer search inside the earlier result."""
    first, then = "report", "report v1"
    assert reusable(first, then)
    return matches(matches(catalog_of(spark, d), first), then).select("entry_id", "name")


def sets(spark, d):
    """Union, intersection and difference of two hit sets as predicates."""
    c = catalog_of(spark, d)
    found = [("union", "report | invoice"), ("both", "report invoice"), ("difference", "report !invoice")]
    out = None
    for kind, text in found:
        one = matches(c, text).select(F.lit(kind).alias("kind"), "entry_id")
        out = one if out is None else out.unionByName(one)
    return out


def paths(spark, d):
    tree = hierarchy(t(spark, d, "entries"), t(spark, d, "volumes"))
    return tree.where("place not in ('on', 'under')").select("vol", "frn", "place", "top", F.col("depth").cast("long").alias("depth"), "path")


def descendants(spark, d):
    tree = hierarchy(t(spark, d, "entries"), t(spark, d, "volumes"))
    return tree.where("place not in ('on', 'under') and n_descendants > 0").select("vol", "frn", "n_descendants")


def folders(spark, d):
    return catalog_of(spark, d).where("visible and place != 'under' and place != 'on'").groupBy("folder").agg(F.count("*").alias("n"))


def split_join(spark, d):
    c = catalog_of(spark, d).where("visible and place = 'in'")
    full = scalar.join_path(F.col("folder"), F.col("name"))
    return c.select("entry_id", scalar.split_folder(full).alias("folder"), scalar.split_name(full).alias("name"), (full == F.col("path")).alias("same"))


def icon_classes(spark, d):
    return catalog_of(spark, d).where("visible").groupBy(scalar.file_class(F.col("name"), F.col("is_dir")).alias("class")).agg(F.count("*").alias("n"))


def long_form(spark, d):
    page = _page("ext:pdf", "name", 100)(spark, d)
    return page.select("position", scalar.utc_minute(F.col("modified_ms")).alias("modified"), scalar.join_path(F.col("path"), F.col("name")).alias("path"))


def json_form(spark, d):
    page = _page("ext:pdf", "name", 100)(spark, d)
    return render.json_lines(page.select("entry_id", "is_dir"))


def folder_runs(spark, d):
    """Consecutive rows of one folder on a page, as the compact form groups them."""
    page = _page("config", "path", 200)(spark, d)
    order = Window.orderBy("position")  # one page
    start = F.coalesce((F.lag("path").over(order) != F.col("path")).cast("int"), F.lit(1))
    runs = page.withColumn("start", start).withColumn("run", F.sum("start").over(order))
    return runs.groupBy("run", "path").agg(F.count("*").alias("n"))


def parents(spark, d):
    n = newest_entries(t(spark, d, "entries"), "parent_frn", "flags")
    p = n.select("vol", F.col("frn").alias("parent_frn"), F.col("entry_id").alias("parent_id"))
    return n.join(p, ["vol", "parent_frn"], "left").select("entry_id", "parent_id")


def parented(spark, d):
    n = newest_entries(t(spark, d, "entries"), "parent_frn")
    return n.join(n.select("vol", F.col("frn").alias("parent_frn")), ["vol", "parent_frn"], "left_semi").groupBy("vol").agg(F.count("*").alias("n"))


def with_volume(spark, d):
    n = newest_entries(t(spark, d, "entries"), "parent_frn")
    v = t(spark, d, "volumes").select("vol", "letter", "enabled")
    return n.join(v, "vol").groupBy("letter", "enabled").agg(F.count("*").alias("n"), F.max("entry_id").alias("last_id"))


def with_metadata(spark, d):
    rows = catalog_of(spark, d).where("visible").select("entry_id", "folder", "name")
    return enrich(rows, t(spark, d, "hits")).where("size is not null").select("entry_id", "size", "modified_ms", "created_ms")


def volume_status(spark, d):
    return status(build_catalog(t(spark, d, "entries"), t(spark, d, "volumes"), paths=False), t(spark, d, "volumes"))


def status_without(spark, d):
    """Status after a volume was removed and another switched off."""
    gone = F.col("letter") == "D"
    v = t(spark, d, "volumes").where(~gone).withColumn("enabled", F.col("enabled") & (F.col("letter") != "E"))
    e = t(spark, d, "entries").join(v.select("vol"), "vol", "left_semi")
    catalog = build_catalog(e, v, paths=False)
    return catalog.groupBy("vol").agg(F.count_if("visible").alias("visible"), F.count("*").alias("n"))


def distinct_parents(spark, d):
    return t(spark, d, "entries").where("parent_frn is not null").select("vol", "parent_frn").distinct()


def size_percentiles(spark, d):
    """Nearest-rank percentiles of sizes per client."""
    h = t(spark, d, "hits").where("size is not null")
    return h.groupBy("client_id").agg(
        F.expr("percentile_disc(0.5) within group (order by size)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) within group (order by size)").cast("long").alias("p95"),
        F.min("size").alias("least"))


def newest(spark, d):
    return newest_entries(t(spark, d, "entries"), "parent_frn", "flags")


def _rec(spark, d):
    return t(spark, d, "raw_usn"), t(spark, d, "volumes")


def journal_kinds(spark, d):
    r = t(spark, d, "raw_usn")
    return r.select("vol", "usn", F.coalesce(classify_reason(F.col("reason")), F.lit("none")).alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("n"))


def journal_effects(spark, d):
    r = current_records(*_rec(spark, d))
    return r.select("vol", "usn", "effect", "makes").distinct().groupBy("effect", "makes").agg(F.count("*").alias("n"))


def metafiles(spark, d):
    r, v = _rec(spark, d)
    one = r.select("vol", "usn", "name", "parent_frn").distinct().join(v.select("vol", "root_frn"), "vol")
    return one.where(is_metafile(F.col("name"), F.col("parent_frn"), F.col("root_frn"))).select("vol", "usn", "name")


def attributes(spark, d):
    return t(spark, d, "raw_usn").groupBy("attrs", map_attributes(F.col("attrs")).alias("flags")).agg(F.count("*").alias("n"))


def packed_ids(spark, d):
    e = t(spark, d, "entries").where("entry_id is not null")
    return e.select("entry_id", scalar.pack_file_id(F.col("vol").cast("long"), F.col("entry_id"), True).alias("id"), scalar.pack_file_id(F.col("vol").cast("long"), F.col("entry_id"), False).alias("narrow"))


def human_sizes(spark, d):
    h = t(spark, d, "hits").where("size is not null")
    return h.groupBy(scalar.human_size(F.col("size")).alias("shown")).agg(F.count("*").alias("n"))


def file_times(spark, d):
    """Times given in units of 100 ns since 1601; those before 1970 are unknown."""
    h = t(spark, d, "hits").where("modified_ms is not null")
    ticks = F.col("modified_ms") * 10_000 + scalar.FILETIME_EPOCH - F.when(F.col("hit_id") % 5 == 0, scalar.FILETIME_EPOCH).otherwise(0)
    return h.select("hit_id", scalar.filetime_ms(ticks).alias("ms")).distinct()


def _store(spark, d) -> SnapshotStore:
    """A snapshot of a data folder, written to the shared folder."""
    store = SnapshotStore(spark, new_table_path(spark, "store"))
    store.save(t(spark, d, "entries"), t(spark, d, "volumes"))
    return store


_STORED = ("entry_id", "vol", "frn", "parent_frn", "name", "flags")


def snapshot_load(spark, d):
    return _store(spark, d).load()[0].select(*_STORED)


def snapshot_swap(spark, d):
    """One volume scanned anew, one removed; the files of the others stay."""
    store = _store(spark, d)
    store.swap_volume(0, t(spark, d, "entries").where("vol = 0 and parent_frn is not null"))
    store.remove_volume("E")
    return store.load()[0].select(*_STORED)


def snapshot_purge(spark, d):
    store = _store(spark, d)
    store.purge_tombstones(0.0)
    return store.load()[0].select(*_STORED)


def gaps(spark, d):
    return journal_gaps(t(spark, d, "raw_usn"), t(spark, d, "volumes"))


QUERIES = {key: _searcher(text) for key, (text, _) in SEARCHES.items()} | {
    "sort_name": _page("report", "name", 100), "sort_name_desc": _page("report", "-name", 100), "sort_path": _page("v1", "path", 100), "sort_path_desc": _page("v1", "-path", 100),
    "sort_modified": _page("ext:pdf", "modified", 300), "sort_modified_desc": _page("ext:pdf", "-modified", 300), "sort_created_desc": _page("ext:txt", "-created", 300),
    "page_offset": _page("backup", "name", 50, 75), "page_past_end": _page("backup", "name", 50, 100_000_000),
    "total_bench": bench_totals, "narrowing": narrowing, "set_operations": sets, "path_rebuild": paths, "path_descendants": descendants, "path_folders": folders, "path_split_join": split_join,
    "icon_classes": icon_classes, "render_long": long_form, "render_json": json_form, "render_runs": folder_runs, "join_parent": parents, "join_semi_parent": parented, "join_volume": with_volume,
    "join_metadata": with_metadata, "status": volume_status, "status_changed": status_without, "distinct_parents": distinct_parents, "size_percentiles": size_percentiles, "newest_rows": newest,
    "journal_kinds": journal_kinds, "journal_effects": journal_effects, "metafiles": metafiles, "attribute_flags": attributes, "packed_ids": packed_ids,
    "human_sizes": human_sizes, "file_times": file_times, "snapshot_load": snapshot_load, "snapshot_swap": snapshot_swap, "snapshot_purge": snapshot_purge, "journal_gaps": gaps,
}

_KIND = """case when reason & 4096 <> 0 then 'rename_old' when reason & 8192 <> 0 then 'rename' when reason & 512 <> 0 then 'delete' when reason & 256 <> 0 then 'create'
  when reason & 65536 <> 0 then 'hard_link' when reason & 2147483648 <> 0 then 'overwrite' end"""
_FLAGS = """(case when attrs & 16 <> 0 then 1 else 0 end + case when attrs & 2 <> 0 then 2 else 0 end + case when attrs & 4 <> 0 then 4 else 0 end + case when attrs & 1024 <> 0 then 8 else 0 end)::int"""
_CLASS = " ".join(f"when regexp_extract(nf, '^.+\\.([^.\\\\/]+)$', 1) in ({', '.join(repr(x) for x in names.split())}) then '{kind}'" for kind, names in scalar.CLASSES.items())

ORACLE = {key: f"{CAT} select entry_id, name from cat c where visible and ({sql})" for key, (_, sql) in SEARCHES.items()} | {
    "sort_name": _page_sql("contains(nf, 'report')", "nf, entry_id", 100), "sort_name_desc": _page_sql("contains(nf, 'report')", "nf desc, entry_id desc", 100),
    "sort_path": _page_sql("contains(nf, 'v1')", "path, entry_id", 100), "sort_path_desc": _page_sql("contains(nf, 'v1')", "path desc, entry_id desc", 100),
    "sort_modified": _page_sql("ext = 'pdf'", "modified_ms nulls last, entry_id", 300, timed=True), "sort_modified_desc": _page_sql("ext = 'pdf'", "modified_ms desc nulls last, entry_id", 300, timed=True),
    "sort_created_desc": _page_sql("ext = 'txt'", "created_ms desc nulls last, entry_id", 300, timed=True),
    "page_offset": _page_sql("contains(nf, 'backup')", "nf, entry_id", 50, 75), "page_past_end": _page_sql("contains(nf, 'backup')", "nf, entry_id", 50, 100_000_000),
    "total_bench": f"{CAT} select " + ", ".join(f"count(*) filter ({s}) q{i:02d}" for i, s in enumerate(BENCH_SQL)) + " from cat where visible",
    "narrowing": f"{CAT} select entry_id, name from cat where visible and contains(nf, 'report') and contains(nf, 'v1')",
    "set_operations": f"""{CAT}, a as (select entry_id from cat where visible and contains(nf, 'report')), b as (select entry_id from cat where visible and contains(nf, 'invoice'))
      select 'union' kind, entry_id from (select * from a union select * from b) union all select 'both', entry_id from (select * from a intersect select * from b)
      union all select 'difference', entry_id from (select * from a except select * from b)""",
    "path_rebuild": f"{CAT} select vol, frn, place, top, depth::bigint depth, path from cat where place <> 'circle'",
    "path_descendants": f"""{CAT}, above as (select e.vol, e.frn start, e.pp as anc from edge e join cat c on c.vol = e.vol and c.frn = e.frn and c.place <> 'circle'
      union all select a.vol, a.start, e.pp from above a join edge e on a.vol = e.vol and a.anc = e.frn) select vol, anc frn, count(*) n_descendants from above group by 1, 2""",
    "path_folders": f"{CAT} select folder, count(*) n from shown where place <> 'circle' group by 1",
    "path_split_join": f"{CAT} select entry_id, folder, name, true same from shown where place = 'in'",
    "icon_classes": f"{CAT} select case when is_dir then 'folder' {_CLASS} else 'file' end as \"class\", count(*) n from cat where visible group by 1",
    "render_long": f"""with page as ({_page_sql("ext = 'pdf'", "nf, entry_id", 100)}) select "position", strftime(make_timestamp(modified_ms * 1000), '%Y-%m-%d %H:%M') modified,
      path || case when path like '%\\' then '' else '\\' end || name path from page""",
    "render_json": f"""with page as ({_page_sql("ext = 'pdf'", "nf, entry_id", 100)}) select '{{"entry_id":' || entry_id || ',"is_dir":' || is_dir || '}}' as line from page""",
    "render_runs": f"""with page as ({_page_sql("contains(nf, 'config')", "path, entry_id", 200)}), s as (select *, case when lag(path) over (order by "position") = path then 0 else 1 end st from page),
      r as (select *, (sum(st) over (order by "position"))::bigint run from s) select run, path, count(*) n from r group by 1, 2""",
    "join_parent": f"with {NEWEST} select n.entry_id, m.entry_id parent_id from newest n left join newest m on n.vol = m.vol and n.p = m.frn",
    "join_semi_parent": f"with {NEWEST} select n.vol, count(*) n from newest n where exists (select 1 from newest m where n.vol = m.vol and n.p = m.frn) group by 1",
    "join_volume": f"with {NEWEST} select letter, enabled, count(*) n, max(entry_id) last_id from newest join volumes v on newest.vol = v.vol group by 1, 2",
    "join_metadata": f"{CAT}, {META} select entry_id, size, modified_ms, created_ms from shown join meta on folder = mp and name = mn where size is not null",
    "status": f"""with {NEWEST} select v.vol, letter, enabled, monitor, count(*) filter (flags & 32768 = 0) live, count(*) filter (flags & 32768 <> 0) dead, coalesce(sum(strlen(name)), 0)::bigint name_bytes,
      case when count(flags) > 0 then count(*) filter (flags & 32768 <> 0) / count(flags) else 0 end garbage from volumes v left join newest n on v.vol = n.vol group by 1, 2, 3, 4""",
    "status_changed": f"""with {NEWEST} select n.vol, count(*) filter (flags & 32768 = 0 and enabled and letter <> 'E') visible, count(*) n from newest n join volumes v on n.vol = v.vol where letter <> 'D' group by 1""",
    "distinct_parents": "select distinct vol, parent_frn from entries where parent_frn is not null",
    "size_percentiles": "select client_id, quantile_disc(size, 0.5) p50, quantile_disc(size, 0.95) p95, min(size) least from hits where size is not null group by 1",
    "newest_rows": "select vol, frn, max(entry_id) entry_id, arg_max_null(parent_frn, entry_id) parent_frn, arg_max_null(flags, entry_id) flags from entries group by 1, 2",
    "journal_kinds": f"select kind, count(*) n from (select distinct vol, usn, coalesce({_KIND}, 'none') kind from raw_usn) group by 1",
    "journal_effects": f"""with r as (select distinct r.vol, usn, {_KIND} kind, coalesce(name like '$%' and parent_frn = root_frn, false) dropped from raw_usn r join volumes v on r.vol = v.vol where usn >= next_usn)
      select case when kind in ('delete', 'overwrite') or not dropped then kind end effect, kind in ('create', 'rename', 'overwrite') and not dropped makes, count(*) n from r group by 1, 2""",
    "metafiles": "select distinct r.vol, usn, name from raw_usn r join volumes v on r.vol = v.vol where name like '$%' and parent_frn = root_frn",
    "attribute_flags": f"select attrs, {_FLAGS} flags, count(*) n from raw_usn group by 1, 2",
    "human_sizes": """with s as (select size, least(5, greatest(0, floor(log2(greatest(size, 1)) / 10)))::int p from hits where size is not null)
      select case when size < 1024 then size || ' B' else printf('%.1f', floor(size / power(1024, p) * 10 + 0.5) / 10) || ' ' || substr('KMGTP', p, 1) || 'B' end shown, count(*) n from s group by 1""",
    "file_times": "select distinct hit_id, case when hit_id % 5 <> 0 then modified_ms end ms from hits where modified_ms is not null",
    "snapshot_load": "select entry_id, vol, frn, parent_frn, name, flags from entries",
    "snapshot_swap": "select e.entry_id, e.vol, e.frn, e.parent_frn, e.name, e.flags from entries e left join volumes v on e.vol = v.vol where (e.vol <> 0 or e.parent_frn is not null) and v.letter <> 'E'",
    "snapshot_purge": "select entry_id, vol, frn, parent_frn, name, flags from entries where coalesce(flags, 0) & 32768 = 0",
    "journal_gaps": "select r.vol, min(usn) first_usn, max(next_usn) next_usn, min(usn) > max(next_usn) gap from raw_usn r join volumes v on r.vol = v.vol group by 1",
    "packed_ids": "select entry_id, vol::bigint * 4294967296 + entry_id as id, case when vol = 0 then entry_id end narrow from entries",
}
