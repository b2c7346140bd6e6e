"""Per-key work without stragglers: fragment-replicate by estimated load.

Loads are estimated with a bounded frequent-items sketch. Keys are bin-packed
onto tasks; a key above its share is split into shards in proportion to its
load, and the matching side of a join is replicated to just those shards.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import parallelism

_TASK, _HASH, _TASKS, _BUCKET, _LIGHT = "__bal_task", "__bal_hash", "__bal_tasks", "__bal_bucket", "__bal_light"
#: Buckets of light keys that are placed by a literal; beyond it by a broadcast table of eight rows a task.
LITERAL_BUCKETS = 4096
#: Most counters the sketch can hold.
SKETCH_ITEMS = 1_000_000


def pack(loads: list[float], bins: int) -> list[int]:
    """Longest-processing-time bin packing; returns the bin of each load."""
    heap = [(0.0, b) for b in range(bins)]
    where = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: -loads[i]):
        load, b = heapq.heappop(heap)
        where[i] = b
        heapq.heappush(heap, (load + loads[i], b))
    return where


@dataclass
class BalancedPlan:
    """Where each key's rows go. ``heavy`` has at most ``4 * tasks`` rows whatever the data."""

    keys: list[str]
    tasks: int
    total: int
    heavy: DataFrame
    heavy_count: int
    bucket_task: list[int]

    def _placed(self, df: DataFrame, keys: list[str]) -> DataFrame:
        hashed = df.withColumn(_HASH, F.xxhash64(*keys))
        if len(self.bucket_task) > LITERAL_BUCKETS:
            light = df.sparkSession.createDataFrame(list(enumerate(self.bucket_task)), f"{_BUCKET} int, {_LIGHT} int")
            hashed = hashed.withColumn(_BUCKET, F.pmod(F.col(_HASH), F.lit(len(self.bucket_task))).cast("int")).join(F.broadcast(light), _BUCKET)
        if self.heavy_count:
            return hashed.join(F.broadcast(self.heavy), _HASH, "left")
        return hashed.withColumn(_TASKS, F.lit(None).cast("array<int>"))

    def _light_task(self) -> Column:
        if len(self.bucket_task) > LITERAL_BUCKETS:
            return F.col(_LIGHT)
        places = F.array(*[F.lit(t) for t in self.bucket_task])
        return F.get(places, F.pmod(F.col(_HASH), F.lit(len(self.bucket_task))).cast("int"))

    def fragment(self, df: DataFrame, shard_on: list[str]) -> DataFrame:
        """Rows of the large side on their tasks; rows alike in ``shard_on`` stay together."""
        shard = F.pmod(F.xxhash64(*[F.col(c) for c in shard_on], F.lit("shard")), F.size(_TASKS)).cast("int")
        task = F.coalesce(F.get(F.col(_TASKS), shard), self._light_task())
        placed = self._placed(df, self.keys).withColumn(_TASK, task)
        return placed.drop(_HASH, _TASKS, _BUCKET, _LIGHT).repartitionById(self.tasks, _TASK)

    def replicate(self, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Rows of the matching side, one copy on every task that holds a shard of their key."""
        task = F.explode(F.coalesce(F.array_distinct(_TASKS), F.array(self._light_task())))
        placed = self._placed(df, keys or self.keys).withColumn(_TASK, task)
        return placed.drop(_HASH, _TASKS, _BUCKET, _LIGHT).repartitionById(self.tasks, _TASK)


def plan_balance(df: DataFrame, keys: list[str], tasks: int | None = None, tracked_per_task: int = 16) -> BalancedPlan:
    """Estimate loads of ``keys`` over all rows of ``df`` and place them on tasks.

    One pass with a mergeable sketch of ``tracked_per_task * tasks`` counters;
    only the at most ``4 * tasks`` heaviest estimates reach the driver. Light
    keys are spread by hash over ``8 * tasks`` buckets, which are packed
    together with the shards. Rows with a null key count in ``total`` and are
    placed like any other key.
    """
    spark = df.sparkSession
    tasks = tasks or parallelism(spark)
    tracked = min(SKETCH_ITEMS, tracked_per_task * tasks)
    top = min(4 * tasks, tracked)
    found = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(h, {top}, {tracked})").alias("top")
    ).first()
    total, share = found["n"], max(1.0, found["n"] / (4 * tasks))
    heavy = [(r["item"], r["count"]) for r in found["top"] or [] if r["count"] > share / 2 and found["n"] > tasks]
    shards = [(h, c / math.ceil(c / share)) for h, c in heavy for _ in range(math.ceil(c / share))]
    rest = max(0, total - sum(c for _, c in heavy)) / (8 * tasks)
    where = pack([load for _, load in shards] + [rest] * (8 * tasks), tasks)
    on: dict[int, list[int]] = {}
    for (h, _), task in zip(shards, where):
        on.setdefault(h, []).append(task)
    table = spark.createDataFrame(list(on.items()) or [(0, [0])], f"{_HASH} long, {_TASKS} array<int>")
    return BalancedPlan(list(keys), tasks, total, table, len(on), where[len(shards):])


def balanced_join(large: DataFrame, small: DataFrame, keys: list[str], shard_on: list[str], how: str = "inner", loads: DataFrame | None = None) -> DataFrame:
    """``large`` joined with ``small`` on ``keys`` (same names on both sides), hot keys of ``large`` split.

    ``small`` may hold any number of rows; it is shuffled, never broadcast, and
    only rows whose key is hot in ``large`` are copied. ``how``: inner, left or
    left_semi, as these leave each large row where it is. Null keys match nothing.
    ``loads`` has the keys of ``large`` where that is dear to compute twice.
    """
    plan = plan_balance(large if loads is None else loads, keys)
    joined = plan.fragment(large, shard_on).join(plan.replicate(small), [_TASK, *keys], how)
    return joined.drop(_TASK)


def balanced_aggregate(
    df: DataFrame, keys: list[str], shard_on: list[str], partial: list[Column], merge: list[Column], plan: BalancedPlan | None = None
) -> DataFrame:
    """Group by ``keys``: ``partial`` per shard of a key, then ``merge`` over its shards.

    Rows alike in ``shard_on`` share a shard, so a distinct count over those
    columns may be summed. The second grouping sees one row per key and shard.
    """
    plan = plan or plan_balance(df, keys)
    return plan.fragment(df, shard_on).groupBy(_TASK, *keys).agg(*partial).groupBy(*keys).agg(*merge)


def folder_results(entries: DataFrame) -> tuple[DataFrame, int]:
    """Per (vol, parent_frn): rows, distinct children, folders, tombstones, first and last sighting; and the count of all rows.

    Every row counts, superseded ones included. A null parent is no folder and
    gives no row; a null vol groups with itself; null seen_at is ignored.
    An empty table gives no rows and total 0.
    """
    rows = entries.select("vol", "parent_frn", "frn", "flags", "seen_at")
    plan = plan_balance(rows, ["vol", "parent_frn"])
    partial = [
        F.count("*").alias("n_rows"),
        F.count_distinct("frn").alias("n_children"),
        F.count_if(F.col("flags").bitwiseAND(1) != 0).alias("n_dirs"),
        F.count_if(F.col("flags").bitwiseAND(0x8000) != 0).alias("n_dead"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    ]
    merge = [F.sum(c).alias(c) for c in ("n_rows", "n_children", "n_dirs", "n_dead")]
    merge += [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    kept = rows.where("parent_frn is not null")
    return balanced_aggregate(kept, ["vol", "parent_frn"], ["frn"], partial, merge, plan), plan.total


def heavy_folders(entries: DataFrame, share: int = 50) -> DataFrame:
    """(vol, parent_frn) of folders holding more than ``1/share`` of all rows."""
    per_folder, total = folder_results(entries)
    return per_folder.where(F.col("n_rows") * share > total).select("vol", "parent_frn")
