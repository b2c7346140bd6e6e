"""Exact totals over a million generated rows after a journal: snapshot, journal, paths and searches together, against a plain count in Python."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pathloom.operators.changefeed import current_state
from pathloom.plans.catalog import build_catalog
from pathloom.query.compiler import compile_node
from pathloom.query.parser import parse
from pathloom.session import materialize

from .data import BITS, volumes

ROWS, RECORDS, ROOT = 1_000_000, 20_000, 3
STEMS = ["budget", "Invoice", "holiday", "scan", "Notes", "sketch", "café", "backup", "old plan", "x"]
EXTENSIONS = ["pdf", "PDF", "py", "jpg", "tar", ""]

# search -> the same condition on (name, names on the path)
SEARCHES = {
    "invoice": lambda n, p: "invoice" in n.lower(), "case:Notes": lambda n, p: "Notes" in n, "ext:pdf": lambda n, p: n.lower().endswith(".pdf"), "*.py": lambda n, p: n.lower().endswith(".py"),
    "café !ext:jpg": lambda n, p: "café" in n.lower() and not n.lower().endswith(".jpg"), '"old plan"': lambda n, p: "old plan" in n.lower(), "path:archive": lambda n, p: any("archive" in x.lower() for x in p),
    r"regex:^s.*7\.tar$": lambda n, p: n.lower().startswith("s") and n.lower().endswith("7.tar"), "sketch | backup": lambda n, p: "sketch" in n.lower() or "backup" in n.lower(), "wfn:x_12": lambda n, p: n.lower() == "x_12",
}


def test_totals(spark, tmp_path):
    rnd = random.Random(20)
    folders = {ROOT: (ROOT, "")}
    for k in range(300):
        folders[10 + k] = (rnd.choice([ROOT, *range(10, 10 + k)]) if k else ROOT, rnd.choice(["work", "Archive", "media"]) + str(k))
    rows = {f: (p, n, 1) for f, (p, n) in folders.items()}
    for i in range(ROWS - len(rows)):
        ext = rnd.choice(EXTENSIONS)
        name = f"{STEMS[int(rnd.random() ** 2 * len(STEMS))]}_{i % 1000}" + ("." + ext if ext else "")
        rows[1000 + i] = (10 if i % 3 else 10 + i % 300, name, 0)
    keys = list(rows)
    table = pa.table({"entry_id": pa.array(range(len(keys)), pa.int64()), "vol": pa.array([0] * len(keys), pa.int32()), "frn": pa.array(keys, pa.int64()), "parent_frn": pa.array([rows[k][0] for k in keys], pa.int64()),
                      "name": [rows[k][1] for k in keys], "flags": pa.array([rows[k][2] for k in keys], pa.int32())})
    pq.write_table(table, tmp_path / "entries.parquet", row_group_size=100_000)

    records, files = [], keys[301:]
    for usn in range(RECORDS):
        kind = rnd.choice(["create", "rename", "delete", "overwrite"])
        frn = 5_000_000 + usn if kind == "create" else rnd.choice(files)
        parent, name = rnd.choice(list(folders)), f"{rnd.choice(STEMS)} moved_{usn}.py"
        records.append((0, usn, frn, parent, BITS[kind], 0, name))
        if kind == "delete":
            rows.pop(frn, None)
        elif kind == "create" or kind == "rename" and frn in rows:
            rows[frn] = (parent, name, 0)

    names = {f: [] for f in folders}
    for f in folders:
        at = f
        while at != ROOT:
            names[f].append(folders[at][1])
            at = folders[at][0]
    want = {q: sum(test(n, [n, *names[p]] if f != ROOT else [n]) for f, (p, n, _) in rows.items()) for q, test in SEARCHES.items()}

    rnd.shuffle(records)
    journal = spark.createDataFrame(records, "vol int, usn long, frn long, parent_frn long, reason long, attrs int, name string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    v = volumes(spark, ((0, "C", ROOT),))
    live = materialize(current_state(spark.read.parquet(str(tmp_path / "entries.parquet")), journal, v).withColumn("entry_id", F.xxhash64("vol", "frn")), "million")
    catalog = materialize(build_catalog(live, v), "catalog")
    row = catalog.where("visible").agg(F.count("*").alias("all"), *[F.count_if(compile_node(parse(q))).alias(f"q{i}") for i, q in enumerate(SEARCHES)]).first()
    assert row["all"] == len(rows)
    assert {q: row[f"q{i}"] for i, q in enumerate(SEARCHES)} == want
