"""The engine: searches, status and volume management over one catalogue."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .plans.catalog import build_catalog
from .plans.search import Result, matches, page_of, search
from .query.parser import reusable
from .session import drop_table, materialize
from .sources.snapshot import SnapshotStore, Targets


PROTOCOL = 3
#: Clients whose last search is remembered.
SESSIONS = 64


class Session:
    """Narrowing while typing: a longer query is answered inside the last complete result."""

    def __init__(self):
        self.query, self.hits, self.epoch = None, None, None


class Engine:
    version = __version__

    def __init__(self, entries: DataFrame, volumes: DataFrame, metadata: DataFrame | None = None, store: SnapshotStore | None = None):
        self.entries, self.volumes, self.metadata, self.store = entries, volumes, metadata, store
        self.epoch, self.waiting, self.sessions = 0, [], {}
        self.targets = store.targets() if store else Targets()
        self.built = materialize(build_catalog(entries, volumes), "catalog")
        self._show()

    def search(self, query: str, limit: int = 1000, offset: int = 0, sort: str = "name", with_meta: bool = True, session: Session | None = None, client_id: int | None = None) -> Result:
        base = self.catalog
        if client_id is not None:
            session = self.sessions.setdefault(client_id, Session())
            while len(self.sessions) > SESSIONS:
                self.sessions.pop(next(iter(self.sessions)))
        if session and session.query is not None and session.epoch == self.epoch and reusable(session.query, query):
            base = session.hits
        result = search(base, query, limit, offset, sort, self.metadata if with_meta else None)
        if session is not None:
            session.query, session.hits, session.epoch = query, result.hits, self.epoch
        return result

    def count(self, query: str) -> int:
        return matches(self.catalog, query).count()

    @property
    def saved(self) -> bool:
        """Whether there is a snapshot to keep in step."""
        return self.store is not None and self.store.header() is not None

    def hello(self) -> dict:
        return {"protocol": PROTOCOL, "version": self.version}

    def status(self) -> DataFrame:
        return status(self.catalog, self.volumes)

    def _show(self) -> None:
        """Visibility follows the volumes at query time, so their flags cost no rebuild. Volumes are a handful of rows."""
        self.epoch += 1
        on = [r["vol"] for r in self.volumes.where("vol is not null and enabled").select("vol").distinct().collect()]
        self.catalog = self.built.withColumn("visible", F.col("is_live") & F.coalesce(F.col("vol").isin(on), F.lit(False)) if on else F.lit(False))

    def _replace(self, catalog: DataFrame) -> None:
        old, self.built = self.built, materialize(catalog, "catalog")
        drop_table(old.sparkSession, old)
        self._show()

    def set_enabled(self, letter: str, enabled: bool) -> None:
        self._set(letter, "enabled", enabled)

    def set_monitor(self, letter: str, monitor: bool) -> None:
        self._set(letter, "monitor", monitor)

    def _set(self, letter: str, name: str, value: bool) -> None:
        hit = F.col("letter") == letter.upper()
        self.volumes = self.volumes.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
        if self.saved:
            self.store.set_volume(letter, **{name: value})
        self._show()

    def remove_volume(self, letter: str) -> None:
        """Drop a volume; its letter is not taken in again until a rescan names it."""
        gone = [r["vol"] for r in self.volumes.where(F.col("letter") == letter.upper()).select("vol").collect()]
        stays = ~F.coalesce(F.col("vol").isin(gone), F.lit(False)) if gone else F.lit(True)
        self.entries, self.built = self.entries.where(stays), self.built.where(stays)
        self.volumes = self.volumes.where(F.col("letter") != letter.upper())
        self.targets.excluded = sorted({*self.targets.excluded, letter.upper()})
        if self.saved:
            self.store.remove_volume(letter)
        self._show()

    def request_rescan(self, letter: str | None = None) -> list[str]:
        """Queue one volume or all of them; each waits once. Naming a volume lifts its exclusion."""
        letters = [letter.upper()] if letter else sorted(r["letter"] for r in self.volumes.select("letter").distinct().collect())
        if letter and letter.upper() in self.targets.excluded:
            self.targets.excluded.remove(letter.upper())
        self.waiting += [x for x in letters if x not in self.waiting]
        return list(self.waiting)

    def run_rescans(self, scan) -> int:
        """Scan what waits: ``scan(letter)`` gives (vol, entries), or None where the volume cannot be read, which keeps its rows."""
        done = 0
        while self.waiting:
            found = scan(self.waiting.pop(0))
            if found is not None:
                self.rescan(*found)
                done += 1
        return done

    def rescan(self, vol: int, scanned: DataFrame) -> None:
        """Swap in a new scan of one volume; the catalogue of other volumes is kept."""
        self.entries = self.entries.where(F.col("vol") != vol).unionByName(scanned, allowMissingColumns=True)
        if self.saved:
            self.store.swap_volume(vol, scanned)
        self._replace(self.built.where(F.col("vol") != vol).unionByName(build_catalog(scanned.where(F.col("vol") == vol), self.volumes)))

    def set_targets(self, **changes: bool) -> Targets:
        """Change which volumes are taken in; what is not named stays."""
        self.targets = replace(self.targets, **changes)
        if self.saved:
            self.store.set_targets(self.targets)
        return self.targets

    def close(self) -> None:
        """Save, where there is a store."""
        if self.store:
            self.store.save(self.entries, self.volumes, self.targets)


def status(catalog: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per volume: live and dead rows and garbage share; volumes without rows appear with zeros."""
    counts = catalog.groupBy("vol").agg(F.count_if("is_live").alias("live"), F.count_if(~F.col("is_live")).alias("dead"), F.sum(F.octet_length("name")).alias("name_bytes"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("live", "dead", "name_bytes")}
    out = volumes.select("vol", "letter", "enabled", "monitor").join(counts, "vol", "left").withColumns(zero)
    share = F.when(F.col("live") + F.col("dead") > 0, F.col("dead") / (F.col("live") + F.col("dead"))).otherwise(0.0)
    return out.withColumn("garbage", share)
