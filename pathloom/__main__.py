"""``python -m pathloom DATA COMMAND``: exit codes 0 found or done, 1 nothing found, 2 usage, 3 the data cannot be read.

DATA is a folder of tables, or with ``--snapshot`` a snapshot, which then keeps
what volume, config and rescan change.
"""

from __future__ import annotations

import argparse
import json
import sys
import time


def _flag(parser, name: str, dest: str) -> None:
    both = parser.add_mutually_exclusive_group()
    both.add_argument(f"--{name}", dest=dest, action="store_true", default=None)
    both.add_argument(f"--no-{name}", dest=dest, action="store_false")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    top.add_argument("data")
    top.add_argument("--snapshot", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search")
    search.add_argument("query", nargs="*")
    search.add_argument("--limit", type=int, default=100)
    search.add_argument("--offset", type=int, default=0)
    search.add_argument("--sort", default="name")
    search.add_argument("--form", choices=["plain", "long", "json", "compact"], default="plain")
    search.add_argument("--stats", action="store_true", help="total and seconds to the error output")
    for name in ("status", "volumes"):
        commands.add_parser(name).add_argument("--json", action="store_true")
    volume = commands.add_parser("volume")
    volume.add_argument("letter")
    volume.add_argument("--remove", action="store_true")
    _flag(volume, "enabled", "enabled")
    _flag(volume, "monitor", "monitor")
    rescan = commands.add_parser("rescan")
    rescan.add_argument("letter")
    rescan.add_argument("--scan", required=True, help="Parquet of the scan")
    config = commands.add_parser("config")
    for name, dest in (("fixed", "include_fixed"), ("removable", "include_removable"), ("drop-offline", "remove_offline")):
        _flag(config, name, dest)
    commands.add_parser("shutdown")
    bench = commands.add_parser("bench")
    bench.add_argument("--iters", type=int, default=5)
    commands.add_parser("mcp")
    return top


def _table(rows: list[dict], as_json: bool) -> None:
    for r in rows:
        print(json.dumps(r, default=str) if as_json else "  ".join(f"{k}={v}" for k, v in r.items()))


def run(engine, a, spark) -> int:
    from . import render, tools

    if a.command == "search":
        began = time.time()
        found = engine.search(" ".join(a.query), a.limit, a.offset, a.sort)
        page = found.page.orderBy("position") if a.limit else found.page
        if a.form == "compact":
            print(render.compact_text([r.asDict() for r in page.collect()], found.total, a.offset))
        else:
            lines = {"plain": render.plain_lines, "long": render.long_lines, "json": render.json_lines}[a.form]
            for row in lines(page).toLocalIterator():
                print(row["line"])
        if a.stats:
            print(f"{found.total} found, {time.time() - began:.2f} s", file=sys.stderr)
        return 0 if found.total else 1
    if a.command == "status":
        rows = [r.asDict() for r in engine.status().orderBy("vol").collect()]
        _table(rows, True) if a.json else print(render.status_text(rows))
    elif a.command == "volumes":
        _table([r.asDict() for r in engine.volumes.select("letter", "vol", "enabled", "monitor", "next_usn").orderBy("letter").collect()], a.json)
    elif a.command == "volume":
        if a.remove:
            engine.remove_volume(a.letter)
        if a.enabled is not None:
            engine.set_enabled(a.letter, a.enabled)
        if a.monitor is not None:
            engine.set_monitor(a.letter, a.monitor)
    elif a.command == "rescan":
        from .sources.scan import read_scan, scan_entries

        at = engine.volumes.where(engine.volumes["letter"] == a.letter.upper()).select("vol").first()
        if at is None:
            print(f"no volume {a.letter}", file=sys.stderr)
            return 2
        top = engine.entries.selectExpr("coalesce(max(entry_id) + 1, 0) as top").first()["top"]
        engine.request_rescan(a.letter)
        engine.run_rescans(lambda letter: (at["vol"], scan_entries(read_scan(spark, a.scan), engine.volumes, at["vol"], first_id=top)))
    elif a.command == "config":
        changes = {k: v for k in ("include_fixed", "include_removable", "remove_offline") if (v := getattr(a, k)) is not None}
        print(json.dumps(vars(engine.set_targets(**changes))))
    elif a.command == "shutdown":
        engine.close()
    elif a.command == "bench":
        from .catalog_queries import BENCH

        for query in BENCH:
            took = []
            for _ in range(a.iters):
                began = time.time()
                engine.search(query, 100).page.collect()
                took.append(time.time() - began)
            took.sort()
            rank = lambda share: took[max(0, -(-int(share * len(took)) // 100) - 1)]
            print(f"{query}\t{took[0]:.3f}\t{rank(50):.3f}\t{rank(95):.3f}")
    elif a.command == "mcp":
        tools.serve(engine, sys.stdin, lambda text: (sys.stdout.write(text), sys.stdout.flush()))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)

    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .sources.snapshot import SnapshotError, SnapshotStore
    from .sources.tables import read_table

    spark = SparkSession.builder.getOrCreate()
    try:
        store = SnapshotStore(spark, a.data) if a.snapshot else None
        engine = Engine(*store.load(), store=store) if store else Engine(*(read_table(spark, a.data, t) for t in ("entries", "volumes", "hits")))
    except (SnapshotError, PySparkException) as e:
        print(f"cannot read {a.data}: {e}", file=sys.stderr)
        return 3
    try:
        return run(engine, a, spark)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
