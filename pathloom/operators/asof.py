"""As-of matching that splits hot groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, payload: str, block: int) -> DataFrame:
    """``left`` with the ``payload`` of the last ``right`` row of equal keys and strictly smaller ``at``.

    Each group is cut into blocks of ``at // block``, so that no task holds a
    whole hot group. Inside a block a running window finds the match; across
    blocks the last payload of each is carried forward over block summaries.
    Without a match the payload is null. A null ``at`` on the right matches
    nothing; on the left it gets null. Payloads themselves must not be null.
    """
    blk, side, inside, carried = "__asof_blk", "__asof_side", "__asof_in", "__asof_carry"
    kind = right.schema[payload].dataType
    tagged = left.withColumns({side: F.lit(0), payload: F.lit(None).cast(kind)})
    events = right.where(F.col(at).isNotNull()).select(*keys, at, payload).withColumn(side, F.lit(1))
    both = tagged.unionByName(events, allowMissingColumns=True).withColumn(blk, F.floor(F.col(at) / F.lit(block)))
    # At equal positions left rows come first: the match is strict.
    within = Window.partitionBy(*keys, blk).orderBy(at, side).rowsBetween(Window.unboundedPreceding, -1)
    matched = both.withColumn(inside, F.last(payload, True).over(within))
    summary = both.groupBy(*keys, blk).agg(F.max_by(payload, F.when(F.col(side) == 1, F.col(at))).alias(carried))
    before = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn(carried, F.last(carried, True).over(before))
    joined = matched.where(F.col(side) == 0).join(summary, [*keys, blk], "left")
    return joined.withColumn(payload, F.coalesce(inside, carried)).drop(blk, side, inside, carried)
