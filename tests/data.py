"""Small inputs shared by the tests."""

ENTRIES = "entry_id LONG, vol INT, frn LONG, parent_frn LONG, name STRING, flags INT, seen_at TIMESTAMP_NTZ"
RAW_USN = "vol INT, usn LONG, frn LONG, parent_frn LONG, ts TIMESTAMP_NTZ, reason LONG, attrs INT, name STRING, arrived_at TIMESTAMP_NTZ"
VOLUMES = "vol INT, letter STRING, guid BINARY, journal_id LONG, next_usn LONG, root_frn LONG, enabled BOOLEAN, monitor BOOLEAN"
HITS = "hit_id LONG, client_id LONG, name STRING, path STRING, is_dir BOOLEAN, size LONG, modified_ms LONG, created_ms LONG"

BITS = {"rename_old": 0x1000, "rename": 0x2000, "delete": 0x200, "create": 0x100, "hard_link": 0x10000, "overwrite": 0x80000000, "none": 0x2}


def entries(spark, rows):
    """Rows (vol, frn, parent_frn, name, flags) in insertion order."""
    return spark.createDataFrame([(i, v, f, p, n, fl, None) for i, (v, f, p, n, fl) in enumerate(rows)], ENTRIES)


def volumes(spark, rows=((0, "C", 100),), next_usn=0):
    return spark.createDataFrame([(v, letter, None, 1, next_usn, root, True, True) for v, letter, root in rows], VOLUMES)


def stored(spark, df, path):
    """The same rows as a Parquet scan, which delete vectors need."""
    df.repartition(2).write.parquet(str(path))
    return spark.read.parquet(str(path))


# One volume: folders two deep, names in both cases, one extension spelt in two ways.
HOME = [
    (0, 10, 10, "", 1), (0, 11, 10, "Recipes", 1), (0, 12, 10, "garden", 1), (0, 13, 12, "shed", 1), (0, 21, 11, "lentil_soup.md", 0), (0, 22, 11, "Cake.JPG", 0), (0, 23, 12, "plan.py", 0),
    (0, 24, 12, "beds.py", 0), (0, 25, 10, "TODO.MD", 0), (0, 26, 10, "install.msi", 0), (0, 27, 12, "seeds.json", 0), (0, 28, 13, "shed_tools.csv", 0),
]
TWO_VOLUMES = HOME + [(1, 70, 70, "", 1), (1, 71, 70, "Talks", 1), (1, 73, 71, "2019", 1), (1, 72, 71, "intro.ogg", 0), (1, 74, 73, "closing.WAV", 0)]
# Traps: accents, case twins, wildcards and line feeds in names, dots in odd places, a file that is a parent, letters whose other case is ASCII.
ODD = [
    (0, 10, 10, "", 1), (0, 11, 10, "Straße", 1), (0, 12, 10, "Ärger", 1), (0, 21, 11, "plan.py", 0), (0, 22, 11, "PLAN.Py", 0), (0, 23, 12, "crème brûlée.Txt", 0), (0, 24, 12, "a.b.c.tar", 0),
    (0, 25, 10, ".profile", 0), (0, 26, 10, "what?.log", 0), (0, 27, 10, "50%*off.csv", 0), (0, 28, 10, "NOTICE", 0), (0, 29, 28, "inside a file.md", 0), (0, 30, 10, "two\nlines.log", 0),
    (0, 31, 10, "\u017fetup.exe", 0), (0, 32, 10, "\u212aeys.csv", 0), (0, 33, 12, "x[1]{2}.bak", 0), (0, 34, 12, "ends.", 0), (0, 35, 10, "αβγ_7.log", 0), (0, 36, 10, "aab_aa", 0),
]
