"""Rules on components of any size: spanning forests, rooted trees and visiting orders by rounds of joins.

Nodes are numbers here. A round halves what is left (pointers are followed
twice as far, or every tree joins another), so the number of rounds grows with
the logarithm of the largest component; each is written to the shared folder.
Orders over a node's neighbours or a whole tree come from a sort by range, so
neither a hub nor a giant component meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.functions.numbering import numbered
from sporeline.functions.storage import discard, materialize


def roots_of(pointers: DataFrame) -> DataFrame:
    """(node, root, moved) of (node, to), where ``to`` of a root is the root itself: pointers are followed to their end. A written table."""
    now = materialize(pointers.select("node", F.col("to").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        onward = now.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        last, now = now, materialize(now.join(onward, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")))
        discard(last)
    return now


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, key): the edges (u, v, key; u < v, keys unique) of the forest of least keys (Boruvka).

    In each round every tree takes its edge of least key, found by a minimum
    with map-side combine; trees that took an edge join along it.
    """
    rest = materialize(edges.select("u", "v", "key", F.col("u").alias("cu"), F.col("v").alias("cv")))
    chosen: list[DataFrame] = []
    while not rest.isEmpty():
        sides = rest.select(F.col("cu").alias("node"), F.col("cv").alias("to"), "key", "u", "v").unionByName(rest.select(F.col("cv").alias("node"), F.col("cu").alias("to"), "key", "u", "v"))
        best = materialize(sides.groupBy("node").agg(F.min(F.struct("key", "to", "u", "v")).alias("b")).select("node", "b.*"))
        chosen.append(materialize(best.select("u", "v", "key").distinct()))
        # of two trees that took the same edge, the one of the lesser number stays
        back = best.select(F.col("node").alias("to"), F.col("to").alias("_back"))
        to = F.when((F.col("_back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to"))
        named = roots_of(best.join(back, "to").select("node", to.alias("to")))
        left, right = named.select(F.col("node").alias("cu"), F.col("root").alias("_u")), named.select(F.col("node").alias("cv"), F.col("root").alias("_v"))
        on = rest.join(left, "cu").join(right, "cv").where("_u <> _v").select("u", "v", "key", F.col("_u").alias("cu"), F.col("_v").alias("cv"))
        last, rest = rest, materialize(on)
        discard(last, best, named)
    discard(rest)
    if not chosen:
        return edges.select("u", "v", "key").limit(0)
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def list_ranks(lists: DataFrame) -> DataFrame:
    """(e, left) of linked lists (e, next; null at a list's end): how many elements come after e."""
    now = materialize(lists.select("e", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left")))
    while not now.where("next IS NOT NULL").isEmpty():
        ahead = now.select(F.col("e").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        last, now = now, materialize(now.join(ahead, "next", "left").select("e", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
        discard(last)
    return now.select("e", "left")


def rooted(tree: DataFrame, roots: DataFrame, order: str | None = None) -> DataFrame:
    """(node, parent, root, place, size, spot): trees of edges (u, v) rooted at ``roots`` (root), one in each tree of two nodes or more.

    ``place`` counts a tree's nodes from 0 in the order of a walk that takes
    each subtree whole, ``spot`` does so over all trees, ``size`` is that of
    the node's subtree. With ``order``,
    a column of the edges, a node's children come by it, and then edges are
    given as (u, v) with u the parent.
    """
    sort = F.col(order) if order else F.lit(0)
    # of the edges around a node, the one from its parent comes last, so the walk ends there; without an order any place does
    both = tree.select(F.col("u").alias("a"), F.col("v").alias("b"), sort.alias("o"), F.lit(0).alias("back")).unionByName(
        tree.select(F.col("v").alias("a"), F.col("u").alias("b"), sort.alias("o"), F.lit(1).alias("back"))
    )
    arcs = materialize(numbered(both, [F.col("a"), *([F.col("back"), F.col("o")] if order else []), F.col("b")], "e"))
    around = arcs.groupBy("a").agg(F.min("e").alias("first"), F.max("e").alias("last"))
    # after the arc a -> b comes the arc from b that follows b -> a around b
    turn = arcs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("e").alias("_turn"))
    ring = around.select(F.col("a").alias("b"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    onward = arcs.join(turn, ["a", "b"]).join(ring, "b").withColumn("next", F.when(F.col("_turn") == F.col("_last"), F.col("_first")).otherwise(F.col("_turn") + 1))
    # the walk begins with the first arc of the root, so the list ends before it
    begins = around.join(roots.select(F.col("root").alias("a")), "a").select(F.col("first").alias("next"), F.lit(True).alias("_begin"))
    lists = onward.join(begins, "next", "left").select("e", F.when(F.col("_begin"), F.lit(None)).otherwise(F.col("next")).alias("next"))
    ranks = list_ranks(lists)
    told = materialize(arcs.join(ranks, "e").select("a", "b", "left"))
    discard(arcs)
    reverse = told.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("left").alias("_left"))
    down = materialize(told.join(reverse, ["a", "b"]).where("left > _left").select(F.col("b").alias("node"), F.col("a").alias("parent"), "left", ((F.col("left") - F.col("_left") + 1) / 2).cast("long").alias("size")))
    pointers = down.select("node", F.col("parent").alias("to")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("to")))
    homes = roots_of(pointers)
    none = F.lit(None).cast("long")
    tops = roots.select("root", F.col("root").alias("node"), none.alias("parent"), F.lit(2**62).alias("left"), none.alias("size"))
    every = down.join(homes.select("node", "root"), "node").unionByName(tops)
    ordered = materialize(numbered(every, [F.col("root"), F.col("left").desc()], "spot"))
    starts = ordered.groupBy("root").agg(F.min("spot").alias("_low"), F.count("*").alias("_nodes"))
    out = ordered.join(starts, "root").select("node", "parent", "root", (F.col("spot") - F.col("_low")).alias("place"), F.coalesce("size", "_nodes").alias("size"), "spot")
    discard(told, down, homes)
    return out


def nearest_greater(nodes: DataFrame) -> DataFrame:
    """(node, above) of (node, parent, key): the nearest ancestor whose key is greater; roots have the greatest key and no row.

    Steps of 1, 2, 4, ... ancestors and the greatest key on each are worked
    out by doubling; then each node goes up by ever shorter steps that pass
    only lesser keys.
    """
    keys = nodes.select(F.col("node").alias("parent"), F.col("key").alias("_key"))
    steps = materialize(nodes.join(keys, "parent", "left").select("node", F.col("parent").alias("up"), F.col("_key").alias("most")))
    levels = [steps]
    while not levels[-1].where("up IS NOT NULL").isEmpty():
        now = levels[-1]
        ahead = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("most").alias("_most"))
        further = now.where("up IS NOT NULL").join(ahead, "up").where("_up IS NOT NULL")
        levels.append(materialize(further.select("node", F.col("_up").alias("up"), F.greatest("most", "_most").alias("most"))))
    at = materialize(nodes.where("parent IS NOT NULL").select("node", "key", F.col("node").alias("at")))
    for level in reversed(levels):
        if level.where("up IS NOT NULL").isEmpty():
            continue
        step = level.where("up IS NOT NULL").select(F.col("node").alias("at"), "up", "most")
        last, at = at, materialize(at.join(step, "at", "left").select("node", "key", F.when(F.col("most") < F.col("key"), F.col("up")).otherwise(F.col("at")).alias("at")))
        discard(last)
    found = materialize(at.join(steps.select(F.col("node").alias("at"), "up"), "at").select("node", F.col("up").alias("above")))
    discard(at, *levels)
    return found


def subtree_least(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(node, least) over each node's subtree: ``nodes`` has node, spot and size, ``values`` (node, value).

    A subtree is a run of places, covered by two runs whose length is a power
    of two; the least values of such runs come by doubling.
    """
    asked = materialize(nodes.select("node", "spot", "size", (F.length(F.bin("size")) - 1).alias("level")))
    runs = materialize(nodes.join(values, "node", "left").select("spot", "value"))
    top = asked.agg(F.max("level").alias("m")).first()["m"]
    out = []
    for j in range((top if top is not None else -1) + 1):
        mine = asked.where(F.col("level") == j)
        one = runs.select("spot", F.col("value").alias("_a"))
        two = runs.select((F.col("spot") + (1 << j)).alias("_end"), F.col("value").alias("_b"))
        found = mine.join(one, "spot", "left").withColumn("_end", F.col("spot") + F.col("size")).join(two, "_end", "left")
        out.append(materialize(found.select("node", F.least("_a", "_b").alias("least"))))
        next_ = runs.select((F.col("spot") - (1 << j)).alias("spot"), F.col("value").alias("_v"))
        last, runs = runs, materialize(runs.join(next_, "spot", "left").select("spot", F.least("value", "_v").alias("value")))
        discard(last)
    discard(asked, runs)
    if not out:
        return nodes.select("node", F.lit(None).cast(values.schema["value"].dataType).alias("least")).limit(0)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
