"""Versioned snapshots: Parquet folders by volume and a pointer that moves atomically.

A version names the folder of each volume, so a change writes what it touches
and points to the rest.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SCHEMAS

MAGIC = "pathloom-snapshot-1"
#: Share of tombstones from which a snapshot is worth compacting.
GARBAGE = 0.10


class SnapshotError(Exception):
    pass


@dataclass
class Targets:
    """Which volumes are taken in: fixed and removable arrivals, removal of vanished ones, excluded letters."""

    include_fixed: bool = True
    include_removable: bool = False
    remove_offline: bool = False
    excluded: list[str] = field(default_factory=list)

    def adopts(self, letter: str, removable: bool) -> bool:
        return letter.upper() not in self.excluded and (self.include_removable if removable else self.include_fixed)


class SnapshotStore:
    """Snapshots below ``root``, a folder all executors reach. Readers always see one whole version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        try:
            return "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").collect())
        except Exception as e:
            raise SnapshotError(f"{name} cannot be read") from e

    def _write_text(self, name: str, text: str) -> None:
        temporary, target = self._path(f"{self.root}/.{name}.tmp"), self._path(f"{self.root}/{name}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        # One atomic step: a reader finds the old pointer or the new one.
        jvm = self.spark.sparkContext._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, target, options)

    def header(self) -> dict | None:
        """Header of the current version, or None. Damaged and foreign headers are refused."""
        text = self._read_text("current.json")
        if text is None:
            return None
        try:
            head = json.loads(text)
        except ValueError as e:
            raise SnapshotError("damaged header") from e
        if head.get("magic") != MAGIC:
            raise SnapshotError("not a snapshot")
        return head

    def _claim(self, head: dict | None) -> tuple[int, str]:
        """The number and folder of a new version; its claim is created exclusively, so no two writers share one."""
        version = (head["version"] if head else 0) + 1
        while True:
            claim = self._path(f"{self.root}/v{version:08d}.claim")
            try:
                self._fs.create(claim, False).close()
                return version, f"v{version:08d}"
            except Exception:  # noqa: BLE001 - taken by another writer, or not writable at all
                if not self._fs.exists(claim):
                    raise
                version += 1

    def _commit(self, before: dict | None, after: dict) -> int:
        """Move the pointer, unless another save came in between."""
        now = self.header()
        if (now or {}).get("version") != (before or {}).get("version"):
            raise SnapshotError("another save came first")
        self._write_text("current.json", json.dumps({"magic": MAGIC} | after))
        return after["version"]

    def _write_volumes_of(self, entries: DataFrame, folder: str) -> dict[str, list]:
        """Write entries by volume; (folder, rows) of each volume that has any."""
        at = f"{self.root}/{folder}/entries"
        entries.write.mode("overwrite").partitionBy("vol").parquet(at)
        if entries.isEmpty():
            return {}
        counts = self.spark.read.schema(SCHEMAS["entries"]).parquet(at).groupBy("vol").count().collect()
        return {str(r["vol"]): [folder, r["count"]] for r in counts}

    def save(self, entries: DataFrame, volumes: DataFrame, targets: Targets | None = None, scanning: bool = False, stamp: int | None = None) -> int:
        """Write a new version and move the pointer. Refused during a scan; skipped when ``stamp`` says nothing changed."""
        if scanning:
            raise SnapshotError("a scan is running")
        old = self.header()
        if old and stamp is not None and old.get("stamp") == stamp:
            return old["version"]
        version, folder = self._claim(old)
        volumes.write.mode("overwrite").parquet(f"{self.root}/{folder}/volumes")
        parts = self._write_volumes_of(entries, folder)
        kept = asdict(targets) if targets else (old or {}).get("targets", asdict(Targets()))
        return self._commit(old, {"version": version, "epoch": (old or {}).get("epoch", 0) + 1, "parts": parts, "volumes": folder, "stamp": stamp, "targets": kept})

    def _changed(self, head: dict, volumes: DataFrame | None = None, replaced: dict[int, DataFrame] | None = None, gone: tuple = (), **header) -> int:
        """A new version that shares with the old one all that did not change."""
        version, folder = self._claim(head)
        after = {k: head[k] for k in ("epoch", "parts", "volumes", "stamp", "targets")} | {"version": version, "stamp": None} | header
        if volumes is not None:
            volumes.write.mode("overwrite").parquet(f"{self.root}/{folder}/volumes")
            after["volumes"] = folder
        parts = {vol: part for vol, part in head["parts"].items() if vol not in map(str, gone)}
        rows = None
        for vol, df in (replaced or {}).items():
            parts.pop(str(vol), None)
            kinds = [f.split() for f in SCHEMAS["entries"].split(", ")]
            df = df.select(*[F.lit(vol).cast(kind).alias(c) if c == "vol" else (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])
            rows = df if rows is None else rows.unionByName(df)
        if rows is not None:
            parts |= self._write_volumes_of(rows, folder)
        return self._commit(head, after | {"parts": parts})

    def _head(self) -> dict:
        head = self.header()
        if head is None:
            raise SnapshotError("no snapshot")
        return head

    def load(self, vol: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(entries, volumes) of the current version, or of one of its volumes; refused when rows are missing."""
        head, entries = self._head(), self.spark.createDataFrame([], SCHEMAS["entries"])
        by_folder: dict[str, list[str]] = {}
        for name, (folder, _) in head["parts"].items():
            if vol is None or name == str(vol):
                by_folder.setdefault(folder, []).append("vol=" + ("__HIVE_DEFAULT_PARTITION__" if name == "None" else name))
        for folder, names in sorted(by_folder.items()):
            base = f"{self.root}/{folder}/entries"
            try:
                entries = entries.unionByName(self.spark.read.schema(SCHEMAS["entries"]).option("basePath", base).parquet(*[f"{base}/{n}" for n in names]))
            except Exception as e:
                raise SnapshotError("snapshot is truncated") from e
        if entries.count() != sum(n for name, (_, n) in head["parts"].items() if vol is None or name == str(vol)):
            raise SnapshotError("snapshot is truncated")
        return entries, self.spark.read.schema(SCHEMAS["volumes"]).parquet(f"{self.root}/{head['volumes']}/volumes")

    def volumes(self) -> DataFrame:
        return self.spark.read.schema(SCHEMAS["volumes"]).parquet(f"{self.root}/{self._head()['volumes']}/volumes")

    def targets(self) -> Targets:
        head = self.header()
        return Targets(**head["targets"]) if head else Targets()

    def set_targets(self, targets: Targets) -> int:
        """Change which volumes are taken in; no table is written."""
        return self._changed(self._head(), targets=asdict(targets))

    def swap_volume(self, vol: int, scanned: DataFrame) -> int:
        """Replace the rows of one volume by a new scan; the files of other volumes stay."""
        return self._changed(self._head(), replaced={vol: scanned})

    def remove_volume(self, letter: str) -> int:
        """Drop a volume with its rows and exclude its letter from being taken in again; no entries are written."""
        volumes, targets = self.volumes(), self.targets()
        gone = [r["vol"] for r in volumes.where(F.col("letter") == letter.upper()).select("vol").collect()]
        targets.excluded = sorted({*targets.excluded, letter.upper()})
        return self._changed(self._head(), volumes=volumes.where(F.col("letter") != letter.upper()), gone=tuple(gone), targets=asdict(targets))

    def set_volume(self, letter: str, **flags: bool) -> int:
        """Change ``enabled`` or ``monitor`` of a volume; no entries are written."""
        volumes = self.volumes()
        for name, value in flags.items():
            volumes = volumes.withColumn(name, F.when(F.col("letter") == letter.upper(), F.lit(value)).otherwise(F.col(name)))
        return self._changed(self._head(), volumes=volumes)

    def _shares(self) -> list:
        dead = F.coalesce("flags", F.lit(0)).bitwiseAND(0x8000) != 0
        return self.load()[0].groupBy("vol").agg(F.count("*").alias("n"), F.count_if(dead).alias("dead")).collect()

    def garbage(self) -> float:
        shares = self._shares()
        return sum(r["dead"] for r in shares) / max(1, sum(r["n"] for r in shares))

    def purge_tombstones(self, least: float = GARBAGE) -> bool:
        """Rewrite volumes without their tombstones past a share of garbage. A later rename or overwrite may then revive a purged key."""
        shares = self._shares()
        if sum(r["dead"] for r in shares) <= least * max(1, sum(r["n"] for r in shares)):
            return False
        live = {r["vol"]: self.load(r["vol"])[0].where(F.coalesce("flags", F.lit(0)).bitwiseAND(0x8000) == 0) for r in shares if r["dead"] and r["vol"] is not None}
        self._changed(self._head(), replaced=live)
        return True

    def compact(self) -> int:
        """Rewrite all volumes without tombstones, ids numbered anew in their old order; the epoch rises, as kept ids are void."""
        from .scan import with_ids

        entries, volumes = self.load()
        live = entries.where(F.coalesce("flags", F.lit(0)).bitwiseAND(0x8000) == 0).withColumnRenamed("entry_id", "__old")
        return self.save(with_ids(live, "__old").select(*entries.columns), volumes)

    def vacuum(self) -> int:
        """Delete the folders that the current version does not use; returns how many."""
        head = self._head()
        used = {head["volumes"], *(folder for folder, _ in head["parts"].values())}
        old = [f.getPath() for f in self._fs.listStatus(self._path(self.root)) if f.isDirectory() and f.getPath().getName() not in used and f.getPath().getName().startswith("v")]
        old = [p for p in old if int(p.getName()[1:]) < head["version"]]
        for p in old:
            self._fs.delete(p, True)
        return len(old)
