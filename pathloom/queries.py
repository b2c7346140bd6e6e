"""Driver queries of the general operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog_queries
from .operators import balance, changefeed, hierarchy, orphans
from .sources.tables import newest_entries, read_table as t

# --- problems 2 to 5 -------------------------------------------------------


def p2_found(spark, d):
    return orphans.orphan_references(t(spark, d, "entries"), t(spark, d, "raw_usn"), t(spark, d, "volumes")).select("tab", "vol", "row_key", "kind")


def p2_orphans_by_day(spark, d):
    return orphans.orphans_by_day(t(spark, d, "entries"), t(spark, d, "raw_usn"), t(spark, d, "volumes"))


def p3_found(spark, d):
    return changefeed.touched_state(t(spark, d, "entries"), t(spark, d, "raw_usn"), t(spark, d, "volumes"))


def p3_current_state(spark, d):
    return changefeed.current_state(t(spark, d, "entries"), t(spark, d, "raw_usn"), t(spark, d, "volumes"))


def p4_found(spark, d):
    return balance.heavy_folders(t(spark, d, "entries"))


def p4_folder_results(spark, d):
    return balance.folder_results(t(spark, d, "entries"))[0]


def p4_rows_with_folder(spark, d):
    """Every row with the newest name of its folder: names are copied to the shards of hot folders only."""
    e = t(spark, d, "entries").where("parent_frn is not null").select("entry_id", "vol", "parent_frn")
    names = newest_entries(t(spark, d, "entries"), "name").select("vol", F.col("frn").alias("parent_frn"), F.col("name").alias("folder"))
    return balance.balanced_join(e, names, ["vol", "parent_frn"], ["entry_id"]).select("entry_id", "folder")


def p5_found(spark, d):
    return hierarchy.circles(t(spark, d, "entries"), t(spark, d, "volumes"))


def p5_hierarchy(spark, d):
    return hierarchy.hierarchy(t(spark, d, "entries"), t(spark, d, "volumes"))


PROBLEMS = {f.__name__: f for f in (p2_found, p2_orphans_by_day, p3_found, p3_current_state, p4_found, p4_folder_results, p4_rows_with_folder, p5_found, p5_hierarchy)}

_RECORDS = """
vols as (select vol, max(next_usn) nu, arg_max_null(root_frn, next_usn) root from volumes group by vol),
newest as (select vol, frn, arg_max_null(parent_frn, entry_id) parent_frn, arg_max_null(name, entry_id) name, arg_max_null(coalesce(flags, 0), entry_id) flags,
    arg_max_null(entry_id, entry_id) entry_id, arg_max_null(coalesce(seen_at, timestamp '1900-01-01'), entry_id) seen_at from entries group by vol, frn),
recs as (select *, (kind in ('C','R','O') and not dropped) makes,
    case when kind in ('D','O') or not dropped then kind end eff from (
  select distinct r.vol, usn, frn, parent_frn, name, ts,
    (case when attrs & 16 <> 0 then 1 else 0 end + case when attrs & 2 <> 0 then 2 else 0 end
     + case when attrs & 4 <> 0 then 4 else 0 end + case when attrs & 1024 <> 0 then 8 else 0 end)::int flags,
    case when reason & 4096 <> 0 then 'X' when reason & 8192 <> 0 then 'R' when reason & 512 <> 0 then 'D'
         when reason & 256 <> 0 then 'C' when reason & 65536 <> 0 then 'X' when reason & 2147483648 <> 0 then 'O' else 'X' end kind,
    coalesce(name like '$%' and parent_frn = root, false) dropped
  from raw_usn r join vols v on r.vol = v.vol where usn >= nu))"""

_FOLD = """
born as (select vol, frn, min(usn) made from recs where makes group by 1, 2),
live_from as (select coalesce(n.vol, b.vol) vol, coalesce(n.frn, b.frn) frn, n.frn is not null known, b.made,
    case when n.frn is not null then -1 else b.made end start_usn, n.flags & 32768 <> 0 was_dead
  from newest n full join born b on n.vol = b.vol and n.frn = b.frn),
acts as (select r.*, l.known, l.start_usn from recs r join live_from l on r.vol = l.vol and r.frn = l.frn
  where usn >= start_usn and eff in ('C','R','D','O') and not (eff = 'D' and usn = start_usn))"""

_STATE = f"""with {_RECORDS}, {_FOLD},
sums as (select vol, frn, arg_max_null(eff, usn) filter (eff in ('C','D')) alive,
   arg_max_null(parent_frn, usn) filter (eff in ('C','R') or (not known and usn = start_usn)) set_parent,
   arg_max_null(name, usn) filter (eff in ('C','R') or (not known and usn = start_usn)) set_name,
   count(*) filter (eff in ('C','R') or (not known and usn = start_usn)) n_set,
   arg_max_null(flags, usn) filter (eff in ('C','R','O')) set_flags, count(*) filter (eff in ('C','R','O')) n_flags
  from acts group by 1, 2),
state as (select l.vol, l.frn, case when n_set > 0 then set_parent else n.parent_frn end parent_frn,
   case when n_set > 0 then set_name else n.name end name,
   (case when n_flags > 0 then set_flags else n.flags & 32767 end)::int flags,
   case when alive = 'C' then false when alive = 'D' then true else coalesce(l.was_dead, false) end dead
  from live_from l left join sums s on l.vol = s.vol and l.frn = s.frn
  left join newest n on l.vol = n.vol and l.frn = n.frn)"""

_ORPHANS = f"""with {_RECORDS}, {_FOLD},
refs as (select 'entries' tab, vol, parent_frn k, entry_id row_key, case when seen_at > timestamp '1901-01-01' then seen_at::date end as day
    from newest where flags & 32768 = 0 and parent_frn is not null
  union all select distinct 'raw_usn', vol, parent_frn, usn, ts::date from recs where parent_frn is not null),
turns as (select vol, frn k, usn, eff from acts where eff in ('C','D')),
timed as (select r.*, l.known, l.made, l.was_dead, t.eff from refs r left join live_from l on r.vol = l.vol and r.k = l.frn
  asof left join turns t on r.vol = t.vol and r.k = t.k and r.row_key > t.usn),
kinds as (select tab, vol, row_key, day, case
   when tab = 'entries' then case when known and was_dead then 'deleted' when coalesce(known, false) then null when made is not null then 'late' else 'missing' end
   when not coalesce(known, false) and (made is null or made >= row_key) then case when made > row_key then 'late' else 'missing' end
   when eff = 'D' or (eff is null and coalesce(was_dead, false)) then 'deleted' end kind
 from timed)"""

_WALK = """with recursive newest as (select vol, frn, arg_max_null(parent_frn, entry_id) p from entries group by 1, 2),
up as (select n.vol, n.frn, case when n.frn = v.root_frn then null else n.p end p from newest n left join volumes v on n.vol = v.vol),
edge as (select u.vol, u.frn, u.p from up u join newest n on u.vol = n.vol and u.p = n.frn),
good as (select vol, frn from up u where not exists (select 1 from edge e where e.vol = u.vol and e.frn = u.frn)
  union all select e.vol, e.frn from good g join edge e on e.vol = g.vol and e.p = g.frn),
bad as (select e.* from edge e where not exists (select 1 from good g where g.vol = e.vol and g.frn = e.frn)),
chain as (select vol, frn origin, p spot from bad union select c.vol, c.origin, b.p from chain c join bad b on c.vol = b.vol and c.spot = b.frn)"""

# Circles cut open, subtrees counted, and the numbers handed down from the tops.
_FOREST = rf"""{_WALK},
ring as (select c.vol, c.origin frn, min(o.spot) circle from chain c join chain o on c.vol = o.vol and c.origin = o.origin where c.spot = c.origin group by 1, 2),
link as (select e.* from edge e where not exists (select 1 from ring r where r.vol = e.vol and r.frn = e.frn)),
above as (select vol, frn, p a from link union all select x.vol, x.frn, l.p from above x join link l on l.vol = x.vol and l.frn = x.a),
size as (select vol, a frn, count(*) n from above group by 1, 2),
named as (select n.vol, n.frn, coalesce(v.letter, '?') || ':' drive, coalesce(n.name, '') as name, coalesce(n.frn = v.root_frn, false) is_root
  from (select vol, frn, arg_max_null(name, entry_id) as name from entries group by 1, 2) n left join volumes v on n.vol = v.vol),
placed as (select l.*, coalesce(sum(1 + coalesce(s.n, 0)) over (partition by l.vol, l.p order by k.frn is null, l.frn rows between unbounded preceding and 1 preceding), 0)::bigint off
  from link l left join size s on s.vol = l.vol and s.frn = l.frn left join (select distinct vol, p frn from edge) k on k.vol = l.vol and k.frn = l.frn),
walk as (select n.vol, n.frn, n.frn top, 0 depth, 0::bigint pre, drive || case when is_root then '' else '\' || name end text from named n
    where not exists (select 1 from link l where l.vol = n.vol and l.frn = n.frn)
  union all select p.vol, p.frn, w.top, w.depth + 1, w.pre + 1 + p.off, w.text || '\' || n.name
    from walk w join placed p on p.vol = w.vol and p.p = w.frn join named n on n.vol = p.vol and n.frn = p.frn)"""

ORACLE = {
    "p2_found": f"{_ORPHANS} select tab, vol, row_key, kind from kinds where kind is not null",
    "p2_orphans_by_day": f"{_ORPHANS} select tab, day, kind, count(*) n from kinds where kind is not null group by 1, 2, 3",
    "p3_found": f"{_STATE} select distinct s.vol, s.frn, s.parent_frn, s.name, s.flags from state s join recs r on s.vol = r.vol and s.frn = r.frn where not dead",
    "p3_current_state": f"{_STATE} select vol, frn, parent_frn, name, flags from state where not dead",
    "p4_found": "select vol, parent_frn from entries where parent_frn is not null group by 1, 2 having count(*) * 50 > (select count(*) from entries)",
    "p4_rows_with_folder": """with n as (select vol, frn, arg_max_null(name, entry_id) folder from entries group by 1, 2)
        select entry_id, folder from entries e join n on e.vol = n.vol and e.parent_frn = n.frn""",
    "p4_folder_results": """select vol, parent_frn, count(*) n_rows, count(distinct frn) n_children, count(*) filter (flags & 1 <> 0) n_dirs,
        count(*) filter (flags & 32768 <> 0) n_dead, min(seen_at) first_seen, max(seen_at) last_seen from entries where parent_frn is not null group by 1, 2""",
}
# A chain below a circle never returns to its start, so it is told apart by absence.
ORACLE["p5_hierarchy"] = rf"""{_FOREST} select w.vol, w.frn,
    case when r.frn is not null then case when depth = 0 then 'on' else 'under' end when t.is_root then case when depth = 0 then 'root' else 'in' end when depth = 0 then 'orphan' else 'in_orphan' end place,
    case when r.frn is null and t.is_root then w.top end root_frn, w.top, r.circle, case when r.frn is null then depth end depth, coalesce(s.n, 0) n_descendants,
    case when r.frn is not null then n.name when t.is_root and depth = 0 then text || '\' else text end path, pre
  from walk w join named n on n.vol = w.vol and n.frn = w.frn join named t on t.vol = w.vol and t.frn = w.top
  left join ring r on r.vol = w.vol and r.frn = w.top left join size s on s.vol = w.vol and s.frn = w.frn"""
ORACLE["p5_found"] = f"""{_WALK} select b.vol, b.frn, case when exists (select 1 from chain c where c.vol = b.vol and c.origin = b.frn and c.spot = b.frn) then 'on' else 'under' end place from bad b"""


def queries():
    return PROBLEMS | catalog_queries.QUERIES


def oracle_sql():
    return ORACLE | catalog_queries.ORACLE
