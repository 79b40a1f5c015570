"""Parent-child links to full hierarchies.

Every node has at most one parent. Leaves are peeled first: after m steps upwards only nodes with m generations below
them are still hit, so the image of the m-step map is what m rounds of peeling leave. Steps grow fourfold each round;
what no round can peel is on a cycle. The rest is a forest. Its Euler tour (entry and exit of each node) is one linked list
per tree, ranked by pointer jumping: the distance to the end gives entry and exit positions, the sum of +1 per entry
and -1 per exit gives depths, the end itself names the root. Interval containment is then ancestry.

Rounds are logarithmic in the longest line or the largest tree; each is one equi-join, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import checkpoint, checkpoint_counting, release

#: Brothers are ordered inside this many parts, so that no node's children are sorted in one task.
SIBLING_PARTS = 64
#: Joins in a round: each element is moved so many times as far as its target, so a round quadruples the distance.
LEAPS = 3
#: 4^31 elements are more than any table has.
MOST_ROUNDS = 31


def links(df: DataFrame, node: Column, parent: Column) -> DataFrame:
    """(id, parent): one row per node; parent is null where none exists in the table.

    Null ids are left out. Repeated rows count once; of different parents of one id the smallest counts. A node that
    names itself is a cycle of one.
    """
    rows = df.select(node.alias("id"), parent.alias("parent")).where("id is not null")
    rows = rows.groupBy("id").agg(F.min("parent").alias("parent"))
    known = rows.select(F.col("id").alias("_known"))
    joined = rows.join(known, F.col("parent") == F.col("_known"), "left")
    return joined.select("id", F.col("_known").alias("parent"))


def peel(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lost, cycles) of ``links``.

    lost(id, hit): each node whose line never ends, with a node of the cycle it runs into. cycles(id, parent): the
    nodes on cycles.
    """
    jump = checkpoint(nodes.where("parent is not null").select("id", F.col("parent").alias("hit")))
    before = None
    for _ in range(MOST_ROUNDS):
        left = jump.select("hit").distinct().count()
        if left == 0 or left == before:
            break
        before = left
        new = jump
        for _ in range(LEAPS):
            far = jump.select(F.col("id").alias("_at"), F.col("hit").alias("_far"))
            new = new.join(far, F.col("hit") == F.col("_at")).select("id", F.col("_far").alias("hit"))
        new = checkpoint(new)
        release(jump)
        jump = new
    on_cycle = jump.select(F.col("hit").alias("_on")).distinct()
    return jump, nodes.join(on_cycle, F.col("id") == F.col("_on"), "left_semi")


def cycle_names(cycles: DataFrame) -> DataFrame:
    """(id, cycle): the smallest id on each node's cycle, by jumping."""
    state = checkpoint(cycles.select("id", F.col("parent").alias("hit"), F.least("id", "parent").alias("cycle")))
    for _ in range(MOST_ROUNDS):
        new = state.withColumn("_new", F.lit(False))
        for _ in range(LEAPS):
            far = state.select(F.col("id").alias("_at"), F.col("hit").alias("_far"), F.col("cycle").alias("_low"))
            new = new.join(far, F.col("hit") == F.col("_at")).select(
                "id", F.col("_far").alias("hit"), F.least("cycle", "_low").alias("cycle"), (F.col("_new") | (F.col("_low") < F.col("cycle"))).alias("_new")
            )
        new, changed = checkpoint_counting(new, F.col("_new"))
        state = new.drop("_new")
        if not changed:
            break
    return state.select("id", "cycle")


def euler_tour(forest: DataFrame) -> DataFrame:
    """The list (element, next, step) of a forest of (id, parent); elements are ``>id`` and ``<id``."""
    part = F.pmod(F.xxhash64("id"), F.lit(SIBLING_PARTS)).cast("int")
    children = forest.where("parent is not null").withColumn("_part", part)
    inside = Window.partitionBy("parent", "_part").orderBy("id")
    ordered = children.withColumn("_next", F.lead("id").over(inside))
    groups = children.groupBy("parent", "_part").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    across = Window.partitionBy("parent").orderBy("_part")  # at most SIBLING_PARTS rows
    groups = groups.withColumn("_over", F.lead("_first").over(across)).withColumn("_rank", F.row_number().over(across))
    bridges = groups.where("_over is not null").select(F.col("_last").alias("_from"), "_over")
    brothers = ordered.join(bridges, F.col("id") == F.col("_from"), "left").select(
        F.col("id").alias("_child"), F.coalesce("_next", "_over").alias("_brother")
    )
    first = groups.where("_rank = 1").select(F.col("parent").alias("_mother"), "_first")
    full = forest.join(brothers, F.col("id") == F.col("_child"), "left").join(first, F.col("id") == F.col("_mother"), "left")
    entry = lambda c: F.concat(F.lit(">"), c)
    leave = lambda c: F.concat(F.lit("<"), c)
    down = F.struct(
        entry(F.col("id")).alias("element"), F.coalesce(entry(F.col("_first")), leave(F.col("id"))).alias("next"), F.lit(1).alias("step")
    )
    up = F.struct(
        leave(F.col("id")).alias("element"), F.coalesce(entry(F.col("_brother")), leave(F.col("parent"))).alias("next"), F.lit(-1).alias("step")
    )
    return full.select(F.inline(F.array(down, up)))


def rank_list(tour: DataFrame) -> DataFrame:
    """(element, rank, total, end): elements from here to the end, the sum of their steps, and the last one.

    A round writes the elements that have not reached their end only; those that have stay where they were written.
    """
    state = tour.select("element", "next", F.lit(1).cast("long").alias("rank"), F.col("step").cast("long").alias("total"), F.col("element").alias("end"))
    whole, left = checkpoint_counting(state, F.col("next").isNotNull())
    done, open_ = whole.where("next is null"), whole.where("next is not null")
    while left:
        ahead = done.unionByName(open_).select(
            F.col("element").alias("_at"), F.col("next").alias("_next"), F.col("rank").alias("_rank"), F.col("total").alias("_total"), F.col("end").alias("_end")
        )
        moved = open_
        for _ in range(LEAPS):
            zero = F.lit(0).cast("long")
            moved = moved.join(ahead, F.col("next") == F.col("_at"), "left").select(
                "element", F.col("_next").alias("next"), (F.col("rank") + F.coalesce("_rank", zero)).alias("rank"), (F.col("total") + F.coalesce("_total", zero)).alias("total"), F.coalesce("_end", "end").alias("end")
            )
        moved, left = checkpoint_counting(moved, F.col("next").isNotNull())
        done, open_ = done.unionByName(moved.where("next is null")), moved.where("next is not null")
    return done.drop("next")


def hierarchy(nodes: DataFrame) -> DataFrame:
    """(id, parent, root, depth, entry, exit, descendants) of every node of ``links``.

    depth counts steps to the root (0). entry and exit are positions in the root's Euler tour, from 1: b is a
    descendant of a if both have one root and a.entry < b.entry and b.exit < a.exit. A node on a cycle, or whose line
    runs into one, has depth -1, the smallest id on that cycle as root, and no interval.
    """
    nodes = checkpoint(nodes)
    lost, cycles = peel(nodes)
    lost_part = nodes.limit(0).select("id", "parent", F.col("id").alias("root"))
    forest = nodes
    if not lost.isEmpty():
        named = cycle_names(cycles).select(F.col("id").alias("_on"), F.col("cycle").alias("root"))
        lost = lost.join(named, F.col("hit") == F.col("_on")).select(F.col("id").alias("_lost"), "root")
        lost_part = nodes.join(lost, F.col("id") == F.col("_lost")).select("id", "parent", "root")
        forest = nodes.join(lost, F.col("id") == F.col("_lost"), "left_anti")
    ranked = rank_list(euler_tour(forest))
    side = F.substring("element", 1, 1)
    flat = ranked.select(F.substring("element", 2, 1 << 30).alias("id"), side.alias("_side"), "rank", "total", F.substring("end", 2, 1 << 30).alias("root"))
    entries = flat.where("_side = '>'").select("id", "root", (-F.col("total")).alias("depth"), F.col("rank").alias("_in"))
    exits = flat.where("_side = '<'").select(F.col("id").alias("_id"), F.col("rank").alias("_out"))
    whole = entries.where("id = root").select(F.col("root").alias("_root"), F.col("_in").alias("_whole"))
    trees = (
        forest.join(entries.withColumnRenamed("id", "_e"), F.col("id") == F.col("_e"))
        .join(exits, F.col("id") == F.col("_id"))
        .join(whole, F.col("root") == F.col("_root"))
        .select(
            "id",
            "parent",
            "root",
            "depth",
            (F.col("_whole") - F.col("_in") + 1).alias("entry"),
            (F.col("_whole") - F.col("_out") + 1).alias("exit"),
            ((F.col("_in") - F.col("_out") - 1) / 2).cast("long").alias("descendants"),
        )
    )
    none = F.lit(None).cast("long")
    return trees.unionByName(
        lost_part.select("id", "parent", "root", F.lit(-1).cast("long").alias("depth"), none.alias("entry"), none.alias("exit"), none.alias("descendants"))
    )


def paths(tree: DataFrame) -> DataFrame:
    """(id, path): ids from the root to the node, for nodes with depth >= 0 of :func:`hierarchy`.

    Half paths are joined end to start, so the rounds are logarithmic; the result is as long as the sum of all depths.
    """
    state = tree.where("depth >= 0").select("id", F.col("parent").alias("top"), F.array("id").alias("path"))
    state, left = checkpoint_counting(state, F.col("top").isNotNull())
    done, open_ = state.where("top is null"), state.where("top is not null")
    while left:
        upper = done.unionByName(open_).select(F.col("id").alias("_at"), F.col("top").alias("_top"), F.col("path").alias("_path"))
        moved = open_
        for _ in range(LEAPS):
            moved = moved.join(upper, F.col("top") == F.col("_at"), "left").select("id", F.col("_top").alias("top"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"))
        moved, left = checkpoint_counting(moved, F.col("top").isNotNull())
        done, open_ = done.unionByName(moved.where("top is null")), moved.where("top is not null")
    return done.select("id", "path")


def descendants(tree_paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): every pair once, from :func:`paths`; a line's pairs come from its own path."""
    return tree_paths.select(F.col("id").alias("descendant"), F.size("path").alias("_n"), F.posexplode("path").alias("_i", "ancestor")).where(
        "ancestor <> descendant"
    ).select("ancestor", "descendant", (F.col("_n") - 1 - F.col("_i")).alias("distance"))


def climb(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ended, endless) of edges (id, parent), each id once.

    ended(id, root, level): where the line upwards ends, and after how many steps. endless(id): nodes that no round of
    topological sorting releases, because they are on a cycle or hang on one. A round releases twice as many levels as
    the one before; a round that releases nothing is the last, since levels have no gaps.
    """
    state = edges.select("id", F.col("parent").alias("root"), F.lit(1).cast("int").alias("level"), F.lit(True).alias("open"))
    state, left = checkpoint_counting(state, F.col("open"))
    done, open_ = state.where("not open"), state.where("open")
    while left:
        ahead = done.unionByName(open_).select(F.col("id").alias("_at"), F.col("root").alias("_root"), F.col("level").alias("_level"), F.col("open").alias("_open"))
        moved = open_.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "id", F.coalesce("_root", "root").alias("root"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"), F.coalesce("_open", F.lit(False)).alias("open")
        )
        moved, now = checkpoint_counting(moved, F.col("open"))
        done, open_, before, left = done.unionByName(moved.where("not open")), moved.where("open"), left, now
        if left == before:
            break
    return done.drop("open"), open_.select("id")
