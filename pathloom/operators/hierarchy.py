"""Parent-child rows to full hierarchies by bottom-up leaf peeling.

Each round peels the nodes without remaining children; they send their subtree
size to their parents. The first round takes all nodes that are nobody's parent
and moves none of them. Peeling in reverse then hands out places, depths, paths
and preorder numbers, which encode every node's descendants as one interval.
What can never be peeled lies on a circle. Trees that are still tall after
``MOST_LAYERS`` rounds are finished by pointer doubling, so the number of rounds
follows the logarithm of the height.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_table, materialize
from ..sources.tables import newest_entries

#: A residual of at most this many folders is finished inside one task per volume.
CORE_NODES = 100_000
#: Rounds of peeling before a larger residual is finished by pointer doubling.
MOST_LAYERS = 16
#: Children of a folder are handled in slices of this many low bits of frn: at most 65,536 rows, as (vol, frn) is unique.
SLICE_BITS = 16
#: Slices of a folder are summed in groups of this many bits before whole folders are.
SUM_BITS = 20

_SOLVED = "vol int, frn long, size long, place string, top long, circle long, depth int"
_BAD = "place in ('on', 'under')"


def _for_pandas(rows: DataFrame) -> DataFrame:
    """``up`` without nulls, beside a flag: a long column with nulls would reach pandas as floating-point numbers and lose digits."""
    return rows.withColumns({"has_up": F.col("up").isNotNull(), "up": F.coalesce("up", F.lit(0).cast("long"))})


def _parent_positions(frn: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
    """Position of each parent in the sorted ``frn``, -1 where there is none."""
    wanted = pdf["up"].to_numpy(np.int64)
    at = np.minimum(np.searchsorted(frn, wanted), len(frn) - 1)
    return np.where(pdf["has_up"].to_numpy(bool) & (frn[at] == wanted), at, -1)


def _solve_core(pdf: pd.DataFrame) -> pd.DataFrame:
    """Peel one volume's residual in memory: sizes, places, tops, depths and circles."""
    n, pdf = len(pdf), pdf.sort_values("frn", kind="stable").reset_index(drop=True)
    frn = pdf["frn"].to_numpy(np.int64)
    parent = _parent_positions(frn, pdf)
    size = 1 + pdf["below"].to_numpy(np.int64)
    children = np.bincount(parent[parent >= 0], minlength=n)
    layers, peeled = [], np.zeros(n, bool)
    layer = np.flatnonzero(children == 0)
    while len(layer):
        layers.append(layer)
        peeled[layer] = True
        some = layer[parent[layer] >= 0]
        np.add.at(size, parent[some], size[some])
        np.subtract.at(children, parent[some], 1)
        ups = np.unique(parent[some])
        layer = ups[children[ups] == 0]
    circle = np.full(n, -1, np.int64)
    for start in np.flatnonzero(~peeled):
        if circle[start] < 0:
            ring, x = [], start
            while circle[x] < 0:
                circle[x] = 0
                ring.append(x)
                x = parent[x]
            circle[ring] = frn[ring].min()
    place = np.where(~peeled, "on", np.where(pdf["is_root"].to_numpy(bool), "root", "orphan")).astype(object)
    top, depth = frn.copy(), np.zeros(n, np.int32)
    below = {"on": "under", "under": "under", "root": "in", "in": "in", "orphan": "in_orphan", "in_orphan": "in_orphan"}
    for layer in reversed(layers):
        for i in layer[parent[layer] >= 0]:
            p = parent[i]
            top[i], circle[i], depth[i], place[i] = top[p], circle[p], depth[p] + 1, below[place[p]]
    out = pd.DataFrame({"vol": pdf["vol"], "frn": frn, "size": size, "place": place, "top": top, "circle": pd.array(circle, "Int64"), "depth": depth})
    out.loc[circle < 0, "circle"] = pd.NA
    return out


def _descend(sep: str):
    """Preorder numbers and path texts of one volume's core, from the tops down."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frn", kind="stable").reset_index(drop=True)
        frn, depth = pdf["frn"].to_numpy(np.int64), pdf["depth"].to_numpy(np.int64)
        parent = _parent_positions(frn, pdf)
        off, own = pdf["off"].to_numpy(np.int64), pdf["own"].to_numpy(object)
        pre, text = np.zeros(len(pdf), np.int64), own.copy()
        for i in np.argsort(depth, kind="stable"):
            if depth[i]:
                pre[i] = pre[parent[i]] + 1 + off[i]
                text[i] = text[parent[i]] + sep + own[i]
        return pd.DataFrame({"vol": pdf["vol"], "frn": frn, "pre": pre, "text": text})

    return run


def _nodes(entries: DataFrame, volumes: DataFrame, names: bool) -> DataFrame:
    """Newest rows with their parent (null for roots) and their number of children."""
    v = volumes.where("vol is not null").groupBy("vol").agg(F.max_by("root_frn", "next_usn").alias("root_frn"), F.max_by("letter", "next_usn").alias("letter"))

    def linked(*more: str) -> DataFrame:
        rows = newest_entries(entries, "parent_frn", *more).join(v, "vol", "left").withColumn("is_root", F.coalesce(F.col("frn") == F.col("root_frn"), F.lit(False)))
        return rows.select("vol", "frn", F.when(~F.col("is_root"), F.col("parent_frn")).alias("up"), "is_root", *(["letter", "name"] if more else []))

    # Both sides come out of their aggregations by (vol, frn), so this join moves nothing.
    kids = linked().where("up is not null").groupBy("vol", F.col("up").alias("frn")).agg(F.count("*").alias("kids"))
    rows = linked(*["name"] * names).join(kids, ["vol", "frn"], "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long")))
    return materialize(rows, "nodes")


def _sent(rows: DataFrame, *sums: Column) -> DataFrame:
    return rows.where("up is not null").groupBy("vol", F.col("up").alias("frn")).agg(F.count("*").alias("__n"), *sums)


def _peel(nodes: DataFrame, core_nodes: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Layers of folders, innermost last, the residual and its number of rows.

    Adds leaves (children that are no folders), children (folders not yet
    peeled) and below (descendants counted so far).
    """
    folders = nodes.where("kids > 0")
    left = folders.join(_sent(folders), ["vol", "frn"], "left").withColumn("children", F.coalesce("__n", F.lit(0))).drop("__n")
    left = left.withColumn("leaves", F.col("kids") - F.col("children")).withColumn("below", F.col("leaves")).drop("kids")
    left, layers = materialize(left, "peel"), []
    leaf = F.col("children") == 0
    while True:
        count = left.agg(F.count("*").alias("n"), F.count_if(leaf).alias("leaves")).first()
        if count["n"] <= core_nodes or not count["leaves"] or len(layers) == MOST_LAYERS:
            return layers, left, count["n"]
        layers.append(left.where(leaf))
        sent = _sent(layers[-1], F.sum(F.col("below") + 1).alias("__sum"))
        left = left.where(~leaf).join(sent, ["vol", "frn"], "left").withColumns({
            "children": F.col("children") - F.coalesce("__n", F.lit(0)), "below": F.col("below") + F.coalesce("__sum", F.lit(0))}).drop("__n", "__sum")
        left = materialize(left, "peel")


def _next(now: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """``after``, written; ``now``, which it was made from, is deleted."""
    after = materialize(after, name)
    drop_table(after.sparkSession, now)
    return after


def _circle_ids(ring: DataFrame) -> DataFrame:
    """(vol, frn, circle) of nodes that all lie on circles: the smallest frn of each circle.

    Pointer doubling: after k rounds ``circle`` is the smallest of the 2^k nodes
    from frn on and ``to`` the node behind them. Once a round lowers none, it is
    the smallest of all.
    """
    now = materialize(ring.select("vol", "frn", F.col("up").alias("to"), F.col("frn").alias("circle"), F.lit(True).alias("lowered")), "ring")
    while not now.where("lowered").isEmpty():
        ahead = now.select("vol", F.col("frn").alias("to"), F.col("to").alias("__to"), F.col("circle").alias("__circle"))
        low = F.least("circle", "__circle")
        now = _next(now, now.join(ahead, ["vol", "to"]).select("vol", "frn", F.col("__to").alias("to"), low.alias("circle"), (low < F.col("circle")).alias("lowered")), "ring")
    return now.select("vol", "frn", "circle")


def _doubled_solution(residual: DataFrame) -> DataFrame:
    """What :func:`_solve_core` gives, for a residual of any size and height."""
    keys = residual.select("vol", F.col("frn").alias("up"), F.lit(True).alias("there"))
    linked = materialize(residual.join(keys, ["vol", "up"], "left").select("vol", "frn", F.when(F.col("there"), F.col("up")).alias("up"), "is_root", "below"), "linked")
    # Chains that have not ended after 2^k steps; once their number and that of their targets stay, only circles are left.
    now, before = materialize(linked.select("vol", "frn", F.col("up").alias("to")), "chains"), None
    while True:
        open_ = now.where("to is not null")
        count = (open_.count(), open_.select("vol", "to").distinct().count())
        if not count[0] or count == before:
            break
        ahead = now.select("vol", F.col("frn").alias("to"), F.col("to").alias("__to"))
        now, before = _next(now, now.join(ahead, ["vol", "to"], "left").select("vol", "frn", F.col("__to").alias("to")), "chains"), count
    on = materialize(now.where("to is not null").select("vol", F.col("to").alias("frn")).distinct(), "on")
    circle = _circle_ids(linked.join(on, ["vol", "frn"], "left_semi"))
    # On the forest that is left when circles are cut: distances to the top, and sizes of subtrees within 2^k steps.
    start = linked.join(circle, ["vol", "frn"], "left").withColumn("to", F.when(F.col("circle").isNull(), F.col("up")))
    end = F.col("to").isNull()
    now = materialize(start.select("vol", "frn", "to", F.when(end, F.col("frn")).alias("top"), F.when(end, 0).otherwise(1).alias("depth"), (F.col("below") + 1).alias("size")), "forest")
    while not now.where("to is not null").isEmpty():
        ahead = now.select("vol", F.col("frn").alias("to"), F.col("to").alias("__to"), F.col("top").alias("__top"), F.col("depth").alias("__depth"))
        sent = now.where("to is not null").groupBy("vol", F.col("to").alias("frn")).agg(F.sum("size").alias("__sum"))
        after = now.join(ahead, ["vol", "to"], "left").join(sent, ["vol", "frn"], "left").select(
            "vol", "frn", F.col("__to").alias("to"), F.coalesce("top", "__top").alias("top"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
            (F.col("size") + F.coalesce("__sum", F.lit(0))).alias("size"))
        now = _next(now, after, "forest")
    tops = linked.select("vol", F.col("frn").alias("top"), F.col("is_root").alias("rooted")).join(circle.withColumnRenamed("frn", "top"), ["vol", "top"], "left")
    first = F.col("depth") == 0
    place = F.when(F.col("circle").isNotNull(), F.when(first, "on").otherwise("under")).when(F.col("rooted"), F.when(first, "root").otherwise("in")).otherwise(F.when(first, "orphan").otherwise("in_orphan"))
    return now.join(tops, ["vol", "top"]).select("vol", "frn", "size", place.alias("place"), "top", "circle", "depth")


def _doubled_descent(rows: DataFrame, sep: str) -> DataFrame:
    """What :func:`_descend` gives, for a residual of any size and height."""
    now = materialize(rows.select("vol", "frn", F.when(F.col("depth") > 0, F.col("up")).alias("to"), F.when(F.col("depth") > 0, F.col("off") + 1).otherwise(0).cast("long").alias("pre"), F.col("own").alias("text")), "descent")
    while not now.where("to is not null").isEmpty():
        ahead = now.select("vol", F.col("frn").alias("to"), F.col("to").alias("__to"), F.col("pre").alias("__pre"), F.col("text").alias("__text"))
        after = now.join(ahead, ["vol", "to"], "left").select(
            "vol", "frn", F.col("__to").alias("to"), (F.col("pre") + F.coalesce("__pre", F.lit(0))).alias("pre"), F.concat_ws(sep, "__text", "text").alias("text"))
        now = _next(now, after, "descent")
    return now.drop("to")


def _solve(nodes: DataFrame, core_nodes: int) -> tuple[DataFrame, int, bool, list[DataFrame]]:
    """All folders with layer, size, leaves and, where they are residual, place, top, circle and depth.

    Also the number of layers, whether the residual was small, and the tables all of this is read from.
    """
    layers, residual, n = _peel(nodes, core_nodes)
    small = n <= core_nodes
    solved = _for_pandas(residual.select("vol", "frn", "up", "is_root", "below")).groupBy("vol").applyInPandas(_solve_core, _SOLVED) if small else _doubled_solution(residual)
    solved = materialize(solved, "solved")
    last = residual.drop("below", "children").join(solved, ["vol", "frn"]).withColumn("layer", F.lit(len(layers)))
    blank = [F.lit(None).cast(kind).alias(c) for c, kind in last.select("place", "top", "circle", "depth").dtypes]
    for i, layer in enumerate(layers):
        rows = layer.withColumn("size", F.col("below") + 1).drop("below", "children").select("*", *blank, F.lit(i).alias("layer"))
        last = last.unionByName(rows)
    return last, len(layers), small, [*layers, residual, solved]


def _sliced(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__slice", F.shiftright("frn", SLICE_BITS))


def _before(rows: DataFrame, keys: list[str], at: str, value: str, part: str = "__slice", bits: tuple[int, ...] = (SUM_BITS,)) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of equal ``keys`` and smaller ``at``.

    ``part`` cuts each key into ranges of ``at``, which are summed one by one and then carried on, so that hot keys stay split.
    """
    sums = rows.groupBy(*keys, part).agg(F.sum(value).alias(value))
    if bits:
        sums = _before(sums.withColumn(part + "_", F.shiftright(part, bits[0])), keys, part, value, part + "_", bits[1:])
    else:
        sums = sums.withColumn("before", F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum(value).over(Window.partitionBy(*keys, part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select(*keys, part, F.col("before").alias("__carried"))
    return rows.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(carried, [*keys, part]).withColumn("before", F.col("__inside") + F.col("__carried")).drop("__inside", "__carried")


def _with_parents(rows: DataFrame, parents: DataFrame, how: str = "left", asked: DataFrame | None = None) -> DataFrame:
    """``rows``, sliced, with the columns of their parent (``parents`` is keyed by vol, up).

    A parent is copied to each slice of its children, and children meet it by
    slice: a folder with a third of all rows is spread over many tasks.
    ``asked`` has the slices of ``rows`` where these are dear to compute twice.
    """
    slices = (rows if asked is None else asked).where("up is not null").select("vol", "up", "__slice").distinct().join(parents, ["vol", "up"])
    return rows.join(slices, ["vol", "up", "__slice"], how)


def circles(entries: DataFrame, volumes: DataFrame, core_nodes: int = CORE_NODES) -> DataFrame:
    """(vol, frn, place) of newest rows on a circle of parents (``on``) or below one (``under``).

    Tombstoned rows are nodes too; a parent is looked up within its volume;
    only a volume's root_frn is a root; a null or absent parent ends the chain.
    """
    nodes = _nodes(entries, volumes, False)
    folders, last, _, _ = _solve(nodes, core_nodes)
    known = folders.where((F.col("layer") == last) & F.expr(_BAD)).select("vol", "frn", "place")
    for layer in reversed(range(last)):
        known = materialize(known, "bad")
        rows = folders.where(F.col("layer") == layer).select("vol", "frn", "up")
        known = known.unionByName(_with_parents(_sliced(rows), known.select("vol", F.col("frn").alias("up")), "left_semi").select("vol", "frn", F.lit("under").alias("place")))
    known = materialize(known, "bad")
    leaves = nodes.where("kids = 0 and up is not null").select("vol", "frn", "up")
    under = _with_parents(_sliced(leaves), known.select("vol", F.col("frn").alias("up")), "left_semi")
    return known.unionByName(under.select("vol", "frn", F.lit("under").alias("place")))


_PARENT = ["place", "top", "circle", "depth", "pre", "text", "folders"]


def _placed(rows: DataFrame, sep: str) -> DataFrame:
    """Place, top, circle, depth, pre and text from the parent's (``p_`` columns) and ``off``; rows without a parent are tops."""
    alone, p = F.col("p_place").isNull(), F.col("p_place")
    place = F.when(alone, F.when(F.col("is_root"), "root").otherwise("orphan")).when(p.isin("on", "under"), "under").when(p.isin("root", "in"), "in").otherwise("in_orphan")
    return rows.withColumns({
        "place": place, "top": F.coalesce("p_top", "frn"), "circle": F.col("p_circle"), "depth": F.coalesce(F.col("p_depth") + 1, F.lit(0)),
        "pre": F.when(alone, 0).otherwise(F.col("p_pre") + 1 + F.col("off")).cast("long"), "text": F.when(alone, _own(sep)).otherwise(F.concat_ws(sep, "p_text", _name())),
    })


def _name() -> Column:
    return F.coalesce("name", F.lit(""))


def _own(sep: str) -> Column:
    """Text of a top: the drive, and the name unless it is a root. A root's path ends with the separator, which its text leaves out."""
    drive = F.concat(F.coalesce("letter", F.lit("?")), F.lit(":"))
    return F.when(F.col("is_root"), drive).otherwise(F.concat_ws(sep, drive, _name()))


def hierarchy(entries: DataFrame, volumes: DataFrame, sep: str = "\\", core_nodes: int = CORE_NODES) -> DataFrame:
    """Per newest row of (vol, frn): path, depth, root and all descendants, circles told apart.

    Columns: vol, frn, place (root, in, orphan, in_orphan, on, under), root_frn
    (null outside root and in), top (where the chain ends), circle (smallest
    frn of the circle), depth (null on or under a circle), n_descendants, path
    (the name alone on or under a circle), pre. The descendants of a node are
    the nodes of the same vol and top with pre in (pre, pre + n_descendants];
    on a circle, moreover, all of the same circle. Of siblings, those that have
    children come first in this numbering, then by frn. A null or absent parent
    makes a node the top of its own tree; a null name counts as empty.
    """
    nodes = _nodes(entries, volumes, True)
    folders, last, small, made = _solve(nodes, core_nodes)
    cut = folders.where("up is not null and (place is null or place != 'on')").select("vol", "frn", "up", "size")
    off = _before(_sliced(cut), ["vol", "up"], "frn", "size").select("vol", "frn", F.col("before").alias("off"))
    inner = (F.col("size") - 1 - F.col("leaves")).alias("folders")
    sized = folders.join(off, ["vol", "frn"], "left").select("*", inner).withColumn("off", F.coalesce("off", F.lit(0)))
    sized = materialize(sized, "sized", ["layer"])
    for used in made:
        drop_table(used.sparkSession, used)

    core = sized.where(F.col("layer") == last).withColumn("own", F.when((F.col("depth") == 0) & (F.col("place") != "on"), _own(sep)).otherwise(_name()))
    if small:
        descent = _for_pandas(core.select("vol", "frn", "up", "depth", "off", "own")).groupBy("vol").applyInPandas(_descend(sep), "vol int, frn long, pre long, text string")
    else:
        descent = _doubled_descent(core, sep)
    columns = ["vol", "frn", "name", *_PARENT[:-1], "size", "folders"]
    parts = [materialize(core.join(descent, ["vol", "frn"]).select(*columns), "placed")]

    def parents() -> DataFrame:
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        return known.select("vol", F.col("frn").alias("up"), *[F.col(c).alias(f"p_{c}") for c in _PARENT])

    for layer in reversed(range(last)):
        rows = _with_parents(_sliced(sized.where(F.col("layer") == layer).drop(*_PARENT[:4])), parents())
        parts.append(materialize(_placed(rows, sep).select(*columns), "placed"))

    leaves = nodes.where("kids = 0")
    children = _sliced(leaves.where("up is not null"))
    inside = _before(children.withColumn("one", F.lit(1)), ["vol", "up"], "frn", "one")
    rows = _with_parents(inside, parents(), asked=children).withColumn("off", F.col("p_folders") + F.col("before"))
    alone = leaves.where("up is null")
    out = _placed(rows, sep).withColumn("size", F.lit(1).cast("long")).select(*columns[:-1])
    tops = F.when(F.col("is_root"), "root").otherwise("orphan")
    none = [F.lit(None).cast("long").alias("circle"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pre"), _own(sep).alias("text"), F.lit(1).cast("long").alias("size")]
    out = out.unionByName(alone.select("vol", "frn", "name", tops.alias("place"), F.col("frn").alias("top"), *none))
    for part in parts:
        out = out.unionByName(part.select(*columns[:-1]))
    return out.select(
        "vol", "frn", "place", F.when(F.col("place").isin("root", "in"), F.col("top")).alias("root_frn"), "top", "circle", F.when(~F.expr(_BAD), F.col("depth")).alias("depth"),
        (F.col("size") - 1).alias("n_descendants"), F.when(F.expr(_BAD), _name()).when(F.col("place") == "root", F.concat("text", F.lit(sep))).otherwise(F.col("text")).alias("path"), "pre")
