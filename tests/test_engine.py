import pytest
from pyspark.sql import functions as F

from pathloom import render
from pathloom.engine import Engine, Session
from pathloom.plans.search import SearchRefused, search, sort_columns
from pathloom.sources.scan import JournalGap, check_journal, scan_entries
from pathloom.sources.snapshot import SnapshotError, SnapshotStore, Targets

from .data import HITS, HOME, TWO_VOLUMES, entries, volumes


@pytest.fixture(scope="module")
def engine(spark):
    meta = spark.createDataFrame([
        (1, 1, "plan.py", "C:\\garden", False, 10, 5000, 100), (1, 1, "plan.py", "C:\\garden", False, 10, 5000, 100), (2, 1, "beds.py", "C:\\garden", False, None, 7000, None), (3, 1, None, None, False, 1, 1, 1)], HITS)
    return Engine(entries(spark, TWO_VOLUMES), volumes(spark, ((0, "C", 10), (1, "D", 70))), meta)


def test_pages(engine):
    first = engine.search("", limit=5)
    assert first.total == 17 and [r["position"] for r in first.page.orderBy("position").collect()] == [1, 2, 3, 4, 5]
    assert engine.search("", limit=5, offset=99).page.count() == 0
    assert engine.search("", limit=0).page.count() == 17
    a = [r["entry_id"] for r in engine.search("", limit=100).page.orderBy("position").collect()]
    b = [r["entry_id"] for r in engine.search("", limit=100, sort="-name").page.orderBy("position").collect()]
    assert a == b[::-1]


def test_time_order_keeps_nulls_last(engine):
    for sort, want in (("modified", ["plan.py", "beds.py"]), ("-modified", ["beds.py", "plan.py"])):
        rows = engine.search("file:", limit=100, sort=sort).page.orderBy("position").collect()
        assert [r["name"] for r in rows[:2]] == want and all(r["modified_ms"] is None for r in rows[2:])
        ids = [r["entry_id"] for r in rows[2:]]
        assert ids == sorted(ids)
    with pytest.raises(ValueError):
        search(engine.catalog, "", sort="modified")
    with pytest.raises(ValueError):
        sort_columns("size")


def test_refusal(engine, monkeypatch):
    monkeypatch.setattr("pathloom.plans.search.TIME_SORT_LIMIT", 3)
    with pytest.raises(SearchRefused):
        search(engine.catalog, "", sort="modified", metadata=engine.metadata, guard=True)


def test_orphans_count_but_are_not_shown(spark):
    e = Engine(entries(spark, HOME + [(0, 300, 999, "lost.md", 0), (0, 301, None, "none.md", 0), (0, 302, 11, None, 0), (0, 11, 10, "Cooking", 0x8001)]), volumes(spark, ((0, "C", 10),)))
    r = e.search("ext:md", limit=100)
    assert r.total == 4 and sorted(x["name"] for x in r.page.collect()) == ["TODO.MD", "lentil_soup.md"]
    assert e.search("lentil_soup.md").page.first()["path"] == "C:\\Cooking"  # a dead folder still names the path
    assert e.count("wfn:Recipes") == 0


def test_volumes(spark):
    e = Engine(entries(spark, TWO_VOLUMES), volumes(spark, ((0, "C", 10), (1, "D", 70), (2, "E", 1))))
    assert {r["letter"]: r["live"] for r in e.status().collect()} == {"C": 12, "D": 5, "E": 0}
    e.set_enabled("d", False)
    assert e.count("") == 12
    e.set_enabled("D", True)
    e.set_monitor("D", False)
    assert e.count("") == 17
    s = Session()
    assert e.search("o", session=s).total >= e.search("ogg", session=s).total == 1
    e.remove_volume("C")
    assert e.count("") == 5
    e.rescan(1, entries(spark, [(1, 70, 70, "", 1), (1, 80, 70, "new.txt", 0)]))
    assert e.count("") == 2


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    with pytest.raises(SnapshotError):
        store.load()
    e, v = entries(spark, TWO_VOLUMES + [(0, 25, 10, "TODO.MD", 0x8000), (0, 26, 10, "install.msi", 0x8000)]), volumes(spark, ((0, "C", 10), (1, "D", 70)))
    assert store.save(e, v, Targets(excluded=["Z"]), stamp=7) == 1 and store.save(e, v, stamp=7) == 1
    with pytest.raises(SnapshotError):
        store.save(e, v, scanning=True)
    assert store.load()[0].count() == 19 and store.targets().excluded == ["Z"]
    assert store.purge_tombstones(0.05) and not store.purge_tombstones(0.05)
    assert store.load()[0].count() == 17
    store.swap_volume(1, entries(spark, [(1, 70, 70, "", 1)]))
    assert store.load()[0].count() == 13
    store.set_volume("d", enabled=False)
    assert store.load()[1].where("not enabled").count() == 1
    store.remove_volume("D")
    assert store.load()[0].count() == 12 and store.targets().excluded == ["D", "Z"] and not store.targets().adopts("D", False)
    (tmp_path / "s" / "current.json").write_text("{")
    with pytest.raises(SnapshotError):
        store.load()


def test_versions_share_what_did_not_change(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    v = volumes(spark, ((0, "C", 10), (1, "D", 70)))
    store.save(entries(spark, TWO_VOLUMES + [(1, 75, 70, "gone", 0x8000), (None, 1, 1, "no volume", 0)]), v)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = files()
    store.set_volume("C", enabled=False)
    store.set_targets(Targets(include_removable=True))
    assert store.targets().include_removable and store.load()[0].count() == 19
    assert not [p for p in files().keys() - before.keys() if "entries" in p.parts]
    store.swap_volume(1, entries(spark, [(1, 70, 70, "", 1), (1, 75, 70, "gone", 0x8000)]))
    assert {p.parts[-2] for p in files().keys() - before.keys() if "entries" in p.parts} == {"vol=1"}
    assert store.load(1)[0].count() == 2 and store.load()[0].count() == 15
    head = store.header()
    assert store.compact() > head["version"] and store.header()["epoch"] == head["epoch"] + 1
    ids = sorted(r["entry_id"] for r in store.load()[0].collect())
    assert ids == list(range(14)) and store.vacuum() >= 3 and store.load()[0].count() == 14
    stale, late = store.header(), SnapshotStore(spark, str(tmp_path / "s"))
    store.set_volume("C", enabled=True)
    with pytest.raises(SnapshotError):
        late._commit(stale, stale | {"version": stale["version"] + 1})


def test_tools_and_command_line(spark, tmp_path, capsys):
    from pathloom import tools
    from pathloom.__main__ import main, parser, run

    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.save(entries(spark, TWO_VOLUMES), volumes(spark, ((0, "C", 10), (1, "D", 70))))
    e = Engine(*store.load(), store=store)
    ask = lambda method, key=1, **params: tools.answer(e, {"jsonrpc": "2.0", "id": key, "method": method, "params": params})
    assert ask("initialize", protocolVersion="2025-03-26")["result"]["protocolVersion"] == "2025-03-26" and ask("ping")["result"] == {}
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["search_files", "index_status"]
    said = lambda reply: reply["result"]["content"][0]["text"]
    assert said(ask("tools/call", name="search_files", arguments={"query": "ext:py", "limit": 1})) == "1-1 of 2, next offset 1\nC:\\garden: beds.py"
    assert said(ask("tools/call", name="index_status")).startswith("17 live rows")
    bad = ask("tools/call", name="search_files", arguments={"query": "x", "sort": "size"})
    assert bad["result"]["isError"] and said(bad).startswith("sort must be one of")
    assert ask("nothing")["error"]["code"] == -32601 and ask("tools/call", name="x")["error"]["code"] == -32602
    assert tools.answer(e, {"method": "ping"}) is None and tools.answer(e, [])["error"]["code"] == -32600 and len(tools.answer(e, [{"id": 1, "method": "ping"}, {"method": "ping"}])) == 1
    out = []
    tools.serve(e, ["", "{", '{"id": 2, "method": "ping"}'], out.append)
    assert '"code": -32700' in out[0] and '"id": 2' in out[1] and len(out) == 2
    assert e.request_rescan("d") == ["D"] and e.request_rescan() == ["D", "C"] and e.run_rescans(lambda letter: None) == 0
    do = lambda *words: run(e, parser().parse_args(["DATA", *words]), spark)
    assert do("search", "ext:py", "--stats") == 0 and "C:\\garden\\plan.py" in capsys.readouterr().out and do("search", "nope") == 1
    assert do("volume", "D", "--no-enabled") == 0 and do("config", "--removable") == 0 and do("status") == do("volumes", "--json") == 0 and do("rescan", "Q", "--scan", "x") == 2
    assert store.targets().include_removable and store.volumes().where("not enabled").count() == 1
    spark.createDataFrame([(70, 70, 0x10, "", 1), (90, 70, 0, "fresh.txt", 1)], "frn LONG, parent_frn LONG, attrs INT, name STRING, usn LONG").write.parquet(str(tmp_path / "scan"))
    assert do("rescan", "D", "--scan", str(tmp_path / "scan")) == 0 and store.load()[0].count() == 14
    assert main([str(tmp_path / "none"), "--snapshot", "status"]) == 3 and main([str(tmp_path / "s"), "--snapshot", "search", "plan", "--sort", "no"]) == 2


def test_scan(spark):
    rows = [(100, 100, 0x10, "", 1), (7, 100, 0, "$MFT", 1), (8, 100, 0x12, "b", 1), (8, 100, 0x12, "a", 1), (9, 8, 0, "late", 50), (10, 8, 0, "$x", 2)]
    out = scan_entries(spark.createDataFrame(rows, "frn LONG, parent_frn LONG, attrs INT, name STRING, usn LONG"), volumes(spark), 0, snapshot_usn=10, first_id=5)
    got = {r["frn"]: (r["name"], r["flags"], r["entry_id"]) for r in out.collect()}
    assert got == {8: ("a", 3, 5), 10: ("$x", 0, 6), 100: ("", 1, 7)}
    check_journal(1, 2, 1, 2)
    for bad in ((5, 2, 1, 2), (1, 3, 1, 2)):
        with pytest.raises(JournalGap):
            check_journal(*bad)


def test_rendering(engine):
    page = engine.search("ext:py", limit=10).page
    assert sorted(r["line"] for r in render.plain_lines(page).collect()) == ["C:\\garden\\beds.py", "C:\\garden\\plan.py"]
    assert "1970-01-01 00:00             10 C:\\garden\\plan.py" in [r["line"] for r in render.long_lines(page).collect()]
    assert all('"name"' in r["line"] for r in render.json_lines(page).collect())
    rows = [{"path": "C:\\a", "name": "x", "is_dir": False}, {"path": "C:\\a", "name": "y", "is_dir": True}, {"path": "C:\\b", "name": "z", "is_dir": False}]
    assert render.compact_text(rows, 9) == "1-3 of 9, next offset 3\nC:\\a: x | y\\\nC:\\b: z"
    assert render.frame({"a": "é"}) == '{"a": "é"}\n'.encode()
    assert render.validate_search({"query": "x", "limit": 9999})["limit"] == 500
    for bad in ({}, {"query": "x", "limit": -1}, {"query": "x", "offset": True}, {"query": "x", "sort": "no"}):
        with pytest.raises(ValueError):
            render.validate_search(bad)


def test_scalars(spark):
    from pathloom.functions import scalar

    row = spark.range(1).select(
        F.array(*[F.coalesce(scalar.extension(F.lit(x)), F.lit("-")) for x in ("a.tar.gz", "README", ".hidden", "x.", "a.b/c")]).alias("ext"),
        F.array(*[scalar.split_folder(F.lit(x)) for x in ("C:\\a", "C:\\a\\b")]).alias("folder"),
        F.array(*[scalar.human_size(F.lit(x).cast("long")) for x in (5, 2048, 3 << 30)]).alias("size"),
        scalar.filetime_ms(F.lit(116_444_736_000_000_000 + 25_000).cast("long")).alias("ms"), scalar.filetime_ms(F.lit(0).cast("long")).alias("none"),
        F.length(scalar.truncate_name(F.repeat(F.lit("é"), 40_000))).alias("cut"), scalar.file_class(F.lit(".zip"), F.lit(False)).alias("kind"),
        scalar.pack_file_id(F.lit(1).cast("long"), F.lit(5).cast("long"), True).alias("wide"), scalar.pack_file_id(F.lit(1).cast("long"), F.lit(5).cast("long"), False).alias("narrow")).first()
    assert row["ext"] == ["gz", "-", "hidden", "-", "-"] and row["folder"] == ["C:\\", "C:\\a"] and row["size"] == ["5 B", "2.0 KB", "3.0 GB"]
    assert (row["ms"], row["none"], row["cut"], row["kind"], row["wide"], row["narrow"]) == (2, None, 32767, "file", (1 << 32) + 5, None)
