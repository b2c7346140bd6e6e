import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.operators import balance, changefeed, hierarchy, orphans
from pathloom.operators.asof import asof_before
from pathloom.streaming.journal import StateTable, follow

from .data import BITS, ENTRIES, RAW_USN, entries, stored, volumes

DEAD = 0x8000


def random_case(seed):
    """A small snapshot and journal full of collisions, nulls, repeats and late records."""
    rnd = random.Random(seed)
    snap = [(0, 100, 100, "", 1)] + [(0, rnd.randrange(1, 9), rnd.choice([100, None, *range(1, 12)]), rnd.choice(["a", "$b", None]), rnd.choice([0, 1, DEAD])) for _ in range(7)]
    recs = []
    for usn in rnd.sample(range(1, 200), 30):
        kind = rnd.choice(list(BITS))
        lost = kind == "delete" and rnd.random() < 0.5
        recs.append((0, usn, rnd.randrange(1, 14), None if lost else rnd.choice([100, *range(1, 14)]), None, BITS[kind] | rnd.choice([0, 2]), rnd.choice([None, 0x10, 0x402]), None if lost else rnd.choice(["x", "$y", "z"]), None))
    recs += rnd.sample(recs, 5)
    rnd.shuffle(recs)
    return snap, recs


KINDS = [("rename_old", 0x1000), ("rename", 0x2000), ("delete", 0x200), ("create", 0x100), ("hard_link", 0x10000), ("overwrite", 0x80000000)]


def replay(snap, recs, next_usn=40):
    """The journal applied one record at a time; also the state of every key before each record."""
    state = {}
    for v, f, p, n, fl in snap:
        state[(v, f)] = (p, n, fl)
    base, before, made = dict(state), {}, {}
    for v, usn, f, p, _, reason, attrs, name, _ in sorted({r for r in recs}, key=lambda r: r[1]):
        if usn < next_usn:
            continue
        before[usn] = dict(state)
        kind = next((k for k, b in KINDS if reason & b), None)
        flags = sum(fl for bit, fl in ((0x10, 1), (2, 2), (4, 4), (0x400, 8)) if (attrs or 0) & bit)
        old = state.get((v, f))
        dropped = (name or "").startswith("$") and p == 100
        if kind == "overwrite" and old is None:
            kind = "create"
        if kind in ("create", "rename") and dropped:
            continue
        if kind == "create" or (kind == "rename" and old is None):
            state[(v, f)] = (p, name, flags)
        elif kind == "rename":
            state[(v, f)] = (p, name, flags | old[2] & DEAD)
        elif kind == "delete" and old:
            state[(v, f)] = (old[0], old[1], old[2] | DEAD)
        elif kind == "overwrite":
            state[(v, f)] = (old[0], old[1], flags | old[2] & DEAD)
        if old is None and (v, f) in state:
            made[(v, f)] = usn
    return base, before, made, state


@pytest.mark.parametrize("seed", range(3))
def test_change_feed(spark, tmp_path, seed):
    snap, recs = random_case(seed)
    e = stored(spark, entries(spark, snap).withColumn("__pos", F.lit("clash")), tmp_path / "e")
    j = spark.createDataFrame(recs, RAW_USN).withColumn("kind", F.lit("clash"))
    v = volumes(spark, next_usn=40)
    *_, state = replay(snap, recs)
    live = {k: s for k, s in state.items() if not s[2] & DEAD}
    got = {(r["vol"], r["frn"]): (r["parent_frn"], r["name"], r["flags"]) for r in changefeed.current_state(e, j, v).collect()}
    assert got == live
    touched = {(r[0], r[2]) for r in recs if r[1] >= 40}
    got = {(r["vol"], r["frn"]): (r["parent_frn"], r["name"], r["flags"]) for r in changefeed.touched_state(e, j, v).collect()}
    assert got == {k: s for k, s in live.items() if k in touched}


@pytest.mark.parametrize("seed", range(3))
def test_orphans(spark, seed):
    snap, recs = random_case(seed)
    base, before, made, _ = replay(snap, recs)
    want = set()
    newest = {(v, f): (i, p, fl) for i, (v, f, p, _, fl) in enumerate(snap)}
    for (v, _), (i, p, fl) in newest.items():
        if not fl & DEAD and p is not None:
            up = base.get((v, p))
            kind = ("deleted" if up[2] & DEAD else None) if up else ("late" if (v, p) in made else "missing")
            want |= {("entries", v, i, kind)} if kind else set()
    for r in set(recs):
        if r[1] >= 40 and r[3] is not None:
            up = before[r[1]].get((0, r[3]))
            kind = ("deleted" if up[2] & DEAD else None) if up else ("late" if made.get((0, r[3]), -1) > r[1] else "missing")
            want |= {("raw_usn", 0, r[1], kind)} if kind else set()
    out = orphans.orphan_references(entries(spark, snap), spark.createDataFrame(recs, RAW_USN), volumes(spark, next_usn=40))
    rows = [(r["tab"], r["vol"], r["row_key"], r["kind"]) for r in out.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_empty_tables(spark, tmp_path):
    none, nothing = stored(spark, spark.createDataFrame([], ENTRIES), tmp_path / "e"), spark.createDataFrame([], RAW_USN)
    v = volumes(spark)
    assert changefeed.current_state(none, nothing, v).count() == 0
    assert orphans.orphan_references(none, nothing, v).count() == 0 and orphans.orphans_by_day(none, nothing, v).count() == 0
    assert balance.heavy_folders(none).count() == 0
    assert hierarchy.circles(none, v).count() == 0 and hierarchy.hierarchy(none, v).count() == 0


def test_all_null_rows(spark, tmp_path):
    e = stored(spark, spark.createDataFrame([(None,) * 7] * 3 + [(1, 0, 5, None, None, None, None)], ENTRIES), tmp_path / "e")
    j = spark.createDataFrame([(None,) * 9] * 3, RAW_USN)
    v = volumes(spark)
    assert [r["frn"] for r in changefeed.current_state(e, j, v).collect()] == [5]
    assert orphans.orphan_references(e, j, v).count() == 0 and balance.heavy_folders(e).count() == 0
    assert hierarchy.circles(e, v).count() == 0
    assert [(r["place"], r["path"]) for r in hierarchy.hierarchy(e, v).collect()] == [("orphan", "C:\\")]


def test_runs(spark):
    keys = spark.createDataFrame([(0, k) for k in (1, 2, 3, 7, 8, 65535, 65536)], "vol int, key long")
    runs = {(r["start"], r["end"]) for r in orphans.key_runs(keys).collect()}
    assert runs == {(1, 3), (7, 8), (65535, 65535), (65536, 65536)}
    asked = spark.createDataFrame([(0, k) for k in (0, 1, 3, 4, 8, 9, 65536, 70000)] + [(1, 1)], "vol int, key long")
    assert {(r["vol"], r["key"]) for r in orphans.beyond_runs(asked, orphans.key_runs(keys)).collect()} == {(0, 0), (0, 4), (0, 9), (0, 70000), (1, 1)}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_asof(spark, block):
    rnd = random.Random(block)
    left = [(rnd.choice("ab"), rnd.randrange(50), i) for i in range(80)] + [("a", None, 99)]
    right = [(k, at, f"{k}{at}") for k in "ab" for at in rnd.sample(range(50), 12)] + [("a", None, "x")]
    out = asof_before(spark.createDataFrame(left, "k string, at long, id int"), spark.createDataFrame(right, "k string, at long, v string"), ["k"], "at", "v", block)
    best = lambda k, at: max((a, v) for kk, a, v in right + [(k, -1, None)] if kk == k and a is not None and a < at)[1]
    assert {r["id"]: r["v"] for r in out.collect()} == {i: None if at is None else best(k, at) for k, at, i in left}


def test_balance(spark, monkeypatch):
    rows = [(0, 1 if i % 3 else i, i, 0) for i in range(3000)] + [(0, None, i, 0) for i in range(500)]
    e = entries(spark, [(v, f, p, "n", fl) for v, p, f, fl in rows])
    assert {(r["vol"], r["parent_frn"]) for r in balance.heavy_folders(e).collect()} == {(0, 1)}
    per, total = balance.folder_results(e)
    want = Counter(p for _, p, _, _ in rows if p is not None)
    assert total == 3500 and {r["parent_frn"]: (r["n_rows"], r["n_children"]) for r in per.collect()} == {p: (n, n) for p, n in want.items()}
    plan = balance.plan_balance(e, ["vol", "parent_frn"], tasks=4)
    sizes = [r["count"] for r in plan.fragment(e, ["frn"]).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 1.6 * 3500 / 4  # two thirds of the rows have one key
    small = spark.createDataFrame([(0, 1, "hot"), (0, 3, "three"), (0, 7, "seven")], "vol int, parent_frn long, label string")
    joined = balance.balanced_join(e, small, ["vol", "parent_frn"], ["frn"])
    assert Counter(r["label"] for r in joined.collect()) == {"hot": want[1], "three": 1}
    assert balance.balanced_join(e, small, ["vol", "parent_frn"], ["frn"], "left").count() == 3500
    monkeypatch.setattr(balance, "LITERAL_BUCKETS", 3)
    assert balance.balanced_join(e, small, ["vol", "parent_frn"], ["frn"], "left").count() == 3500
    assert balance.pack([5, 4, 3, 3, 3], 2) in ([0, 1, 1, 0, 1], [0, 1, 1, 1, 0])


def brute_tree(rows, root=100):
    best = {}
    for i, (v, f, p, n, fl) in enumerate(rows):
        best[(v, f)] = (p, n)
    up = {k: ((k[0], p) if k[1] != root and (k[0], p) in best else None) for k, (p, _) in best.items()}
    out = {}
    for k in best:
        chain, x = [], k
        while x is not None and x not in chain:
            chain.append(x)
            x = up[x]
        out[k] = (chain, x)
    return best, up, out


@pytest.mark.parametrize("seed, core", [(1, 400_000), (2, 5)])
def test_hierarchy(spark, seed, core):
    rnd = random.Random(seed)
    rows = [(0, 100, 100, "", 1)] + [(0, f, rnd.choice([100, None, 999, f, *range(1, 25)]), rnd.choice(["n", None, f"x{f}"]), 1) for f in range(1, 25) for _ in range(rnd.choice([1, 1, 2]))]
    rows += [(0, 1000 + i, 999 + i if i else 100, f"d{i}", 1) for i in range(8)]
    best, up, chains = brute_tree(rows)
    df = entries(spark, rows).withColumn("path", F.lit("clash")).withColumn("size", F.lit(1))
    v = volumes(spark)
    got = {(r["vol"], r["frn"]): r for r in hierarchy.hierarchy(df, v, core_nodes=core).collect()}
    assert set(got) == set(best)
    for k, (chain, loop) in chains.items():
        r = got[k]
        if loop is not None:
            assert r["place"] == ("on" if loop == k else "under") and r["depth"] is None and r["root_frn"] is None
            continue
        names = [best[x][1] or "" for x in reversed(chain)]
        rooted = chain[-1][1] == 100
        assert r["path"] == "C:\\" + "\\".join(names[1:] if rooted else names) and r["depth"] == len(chain) - 1 and r["top"] == chain[-1][1]
        below = {x for x, (c, lp) in chains.items() if lp is None and k in c[1:]}
        inside = {x for x, o in got.items() if (o["vol"], o["top"]) == (r["vol"], r["top"]) and r["pre"] < o["pre"] <= r["pre"] + r["n_descendants"] and o["place"] not in ("on", "under")}
        assert below == inside
    bad = {(r["frn"], r["place"]) for r in hierarchy.circles(df, v, core_nodes=core).collect()}
    assert bad == {(k[1], r["place"]) for k, r in got.items() if r["place"] in ("on", "under")}


def test_circle_ids_of_large_residuals(spark):
    """Circles beyond ``core_nodes`` get the same ids, names and descendants as those solved in one task."""
    rnd = random.Random(7)
    frns = rnd.sample(range(1, 99), 40)
    rings = [frns[:13], frns[13:21], frns[21:24], frns[24:25]]
    up = {f: ring[i - 1] for ring in rings for i, f in enumerate(ring)}
    for f in frns[25:]:
        up[f] = rnd.choice(list(up))
    df = entries(spark, [(0, f, p, None if f == frns[0] else f"n{f}", 1) for f, p in up.items()] + [(0, 100, 100, "", 1), (0, 101, 100, "free", 1)])
    circle = {f: min(ring) for ring in rings for f in ring}
    for f in frns[25:]:
        circle[f] = circle[up[f]]
    for core in (5, 400_000):
        got = {r["frn"]: r for r in hierarchy.hierarchy(df, volumes(spark), core_nodes=core).collect()}
        assert {f: r["circle"] for f, r in got.items()} == circle | {100: None, 101: None}
        assert {f: r["path"] for f, r in got.items() if f in circle} == {f: "" if f == frns[0] else f"n{f}" for f in circle}


@pytest.mark.parametrize("seed", [1])
def test_stream_equals_batch(spark, tmp_path, seed):
    snap, recs = random_case(seed)
    *_, state = replay(snap, recs)
    recs = sorted(set(recs), key=lambda r: r[1])
    journal, v = tmp_path / "journal", volumes(spark, next_usn=40)
    current = {}
    for i, r in enumerate(snap):
        current[(r[0], r[1])] = r
    initial = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in current.values()], "vol int, frn long, parent_frn long, name string, flags int")
    table = StateTable(spark, str(tmp_path / "state"), initial)
    for part, at in enumerate(range(0, len(recs), 10)):
        spark.createDataFrame(recs[at:at + 10], RAW_USN).coalesce(1).write.mode("append").parquet(str(journal))
        query = follow(spark, str(journal), table, v, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").glob("batch=*"))
    for _ in range(2):
        got = {(r["vol"], r["frn"]): (r["parent_frn"], r["name"], r["flags"]) for r in table.read(last).collect()}
        assert got == state
        table.compact(last)


@pytest.mark.parametrize("seed", range(2))
def test_stream_in_arrival_order(spark, tmp_path, seed):
    """Late and repeated records in later batches count at their usn, also after a compaction between batches."""
    snap, recs = random_case(seed)
    *_, state = replay(snap, recs)
    late = [(0, usn, 50, 100, None, BITS[kind], None, name, None) for usn, kind, name in ((60, "delete", None), (50, "create", "old"), (60, "delete", None))]
    late += [(0, usn, 51, 100, None, BITS["rename"], None, name, None) for usn, name in ((70, "new"), (65, "old"))]
    state |= {(0, 50): (100, "old", DEAD), (0, 51): (100, "new", 0)}
    current = {(r[0], r[1]): r for r in snap} | {(0, 200): (0, 200, 100, "still", None)}
    state[(0, 200)] = (100, "still", None)
    initial = spark.createDataFrame(list(current.values()), "vol int, frn long, parent_frn long, name string, flags int")
    table, journal, v = StateTable(spark, str(tmp_path / "state"), initial), tmp_path / "journal", volumes(spark, next_usn=40)
    recs = recs + recs[:8]
    for at, part in enumerate([recs[:9] + late[:1], late[1:2] + late[3:4], recs[9:20], recs[20:] + late[2:3] + late[4:]]):
        spark.createDataFrame(part, RAW_USN).coalesce(1).write.mode("append").parquet(str(journal))
        query = follow(spark, str(journal), table, v, str(tmp_path / "checkpoint"), compact_every=2)
        query.awaitTermination()
        assert query.exception() is None
    got = {(r["vol"], r["frn"]): (r["parent_frn"], r["name"], r["flags"]) for r in table.read(at).collect()}
    assert got == state


@pytest.mark.parametrize("core, most", [(0, 1), (3, 16)])
def test_same_hierarchy_at_any_size(spark, monkeypatch, core, most):
    """Peeled layers, pointer doubling and the core in one task give the same rows: tall chains, circles with tails, hot folders, ids beyond 2^53."""
    rnd = random.Random(core + most)
    big = 1 << 60
    up = {100: 100} | {big + i: big + i - 1 if i else 100 for i in range(40)} | {200 + i: 200 + (i + 1) % 7 for i in range(7)} | {300 + i: 299 + i if i else 203 for i in range(11)} | {400: 400, 500: None, 501: 500, 502: 77}
    up |= {big * 2 + (i << 17): rnd.choice([100, big + 39, 310, 401]) for i in range(60)}
    rows = [(0, f, p, rnd.choice([None, f"n{f % 97}"]), 1) for f, p in up.items()] + [(5, f, p, "x", 1) for f, p in ((1, 2), (2, None))]
    rnd.shuffle(rows)
    df, v = entries(spark, rows), volumes(spark)
    want = {(r["vol"], r["frn"]): r for r in hierarchy.hierarchy(df, v).collect()}
    monkeypatch.setattr(hierarchy, "MOST_LAYERS", most)
    monkeypatch.setattr(hierarchy, "SLICE_BITS", 2)
    got = {(r["vol"], r["frn"]): r for r in hierarchy.hierarchy(df, v, core_nodes=core).collect()}
    assert got == want and len(got) == len(rows)
    assert {(r["vol"], r["frn"], r["place"]) for r in hierarchy.circles(df, v, core_nodes=core).collect()} == {(*k, r["place"]) for k, r in want.items() if r["place"] in ("on", "under")}


def test_journal_gaps(spark):
    from pathloom.sources.scan import journal_gaps, resync

    v = volumes(spark, ((0, "C", 100), (1, "D", 100), (2, "E", 100)), next_usn=40)
    j = spark.createDataFrame([(vol, usn, 1, 1, None, 0, 0, "x", None) for vol, usn in ((0, 10), (0, 90), (1, 41), (None, 1), (7, 1), (2, 5))], RAW_USN)
    assert {r["vol"]: r["gap"] for r in journal_gaps(j, v).collect()} == {0: False, 1: True, 2: False}
    again = []
    assert resync(j, v, again.append, {2: 99}) == [1, 2] == again and journal_gaps(j.where("false"), v).count() == 0
