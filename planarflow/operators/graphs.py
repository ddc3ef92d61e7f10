"""Large graphs as tables of edges: components, distances from roots, and 4-cycles.

Edges have u and v, which stand for the same edge in either order; loops and repeats are dropped. Vertices are longs. Steps that
repeat write a table in the shared folder after each round, which ends the lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarflow.sources.folders import written

#: Neighbours of a vertex beyond which its wedges are dealt to several tasks.
HUB = 10_000
#: Wedges of a task: each can be a pair of its own in the task's memory.
WEDGES = 4_000_000


def undirected(edges: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Each edge once, the larger end as u."""
    x = edges.select(*within, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return x.where("u <> v").distinct()


def both_ways(edges: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    return edges.select(*within, "u", "v").unionByName(edges.select(*within, F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, within: Sequence[str] = (), simple: bool = False) -> DataFrame:
    """vertex and component, its least vertex that edges lead to; for vertices with an edge. With further columns, those of many graphs at once.

    Each round every vertex hooks onto its least lesser neighbour, hooks jump to their ends, and edges become those between ends: the number
    of vertices that still have edges at least halves in two rounds, and the edges of a round are read once. Hooks meet by minima that
    combine before the shuffle, so a hub's neighbours are gathered nowhere. simple: edges are a table that undirected() gave."""
    within = list(within)
    edges = edges if simple else written(undirected(edges, within), "edges")
    labels = None
    while True:
        hooks = written(edges.groupBy(*within, F.col("u").alias("vertex")).agg(F.min("v").alias("component")), "hooks")
        moved = True
        while moved:
            jump = hooks.select(*within, F.col("vertex").alias("component"), F.col("component").alias("_far"))
            new = hooks.join(jump, [*within, "component"], "left").select(*within, "vertex", F.coalesce("_far", "component").alias("component"), F.col("_far").isNotNull().alias("_moved"))
            new = written(new, "hooks")
            moved = not new.where("_moved").isEmpty()
            hooks = new.drop("_moved")
        if labels is None:
            ends = edges.select(*within, F.col("v").alias("vertex")).distinct().join(hooks, [*within, "vertex"], "left_anti")
            labels = written(hooks.unionByName(ends.withColumn("component", F.col("vertex"))), "labels")
        else:
            to = hooks.select(*within, F.col("vertex").alias("component"), F.col("component").alias("_to"))
            labels = written(labels.join(to, [*within, "component"], "left").select(*within, "vertex", F.coalesce("_to", "component").alias("component")), "labels")
        for end in ("u", "v"):
            to = hooks.select(*within, F.col("vertex").alias(end), F.col("component").alias("_to"))
            edges = edges.join(to, [*within, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        edges = written(undirected(edges, within), "edges")
        if edges.isEmpty():
            return labels


def distances(edges: DataFrame, roots: DataFrame, simple: bool = False) -> DataFrame:
    """vertex, depth (edges to the nearest root) and parent, its least neighbour one step nearer; roots has vertex.

    One round per depth: the frontier's neighbours, less all that were reached, are the next frontier. simple: edges are a table that undirected() gave."""
    edges = both_ways(edges if simple else written(undirected(edges), "edges"))
    frontier = roots.select("vertex").distinct().select("vertex", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"))
    reached = frontier = written(frontier, "frontier")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = edges.join(frontier, edges["u"] == frontier["vertex"]).groupBy("v").agg(F.min("u").alias("parent"))
        new = step.withColumnRenamed("v", "vertex").join(reached.select("vertex"), "vertex", "left_anti")
        frontier = written(new.select("vertex", F.lit(depth).alias("depth"), "parent"), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def connected(edges: DataFrame) -> bool:
    """Whether edges lead from every vertex to every other."""
    return components(edges).select("component").distinct().limit(2).count() < 2


def opposite_pairs(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """v, w and paths: vertices with that many common neighbours a, w and a both before v in the order by degree.

    A 4-cycle is counted at its last vertex alone. The neighbours of a vertex of many edges are mostly before it, so it is the middle
    of few wedges: their number stays below the edges times the square root of twice their number. They travel as lists of w to the task
    of their v, where alone they are counted; there are as many tasks as keep each to about WEDGES. Those of a hub, as middle or as v, are dealt to several."""
    edges = written(undirected(edges), "edges")
    ranked = written(both_ways(edges).groupBy("u").agg(F.count("*").alias("degree")), "degrees")
    ends = edges.join(ranked.select("u", F.col("degree").alias("du")), "u").join(ranked.select(F.col("u").alias("v"), F.col("degree").alias("dv")), "v")
    # u after v in the order by degree, then by number.
    later = F.struct("du", "u") > F.struct("dv", "v")
    pick = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    down = written(ends.select(pick("u", "v").alias("v"), pick("du", "dv").alias("dv"), pick("v", "u").alias("a"), pick("dv", "du").alias("da")), "down")
    salts = F.ceil(F.col("da") / hub).cast("int")
    first = down.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("a", "salt", "v", "dv")
    second = down.select("a", "da", F.struct(F.col("dv").alias("d"), "v").alias("w")).unionByName(down.select(F.col("v").alias("a"), F.col("dv").alias("da"), F.struct(F.col("da").alias("d"), F.col("a").alias("v")).alias("w")))
    second = second.withColumn("salt", F.pmod(F.xxhash64("w.v"), salts).cast("int")).groupBy("a", "salt").agg(F.collect_list("w").alias("near"))
    before = F.transform(F.filter("near", lambda w: w < F.struct("dv", "v")), lambda w: w["v"])
    lists = first.join(second, ["a", "salt"]).select("v", F.ceil(F.col("dv") / hub).cast("int").alias("parts"), "a", before.alias("near"))
    lists = lists.withColumn("near", F.explode(F.when(F.col("parts") == 1, F.array("near")).otherwise(F.transform("near", lambda w: F.array(w))))).where(F.size("near") > 0)
    lists = lists.withColumn("part", F.when(F.col("parts") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col("near")[0]), F.col("parts")).cast("int")))
    # A vertex has at most da wedges over each a before it.
    most = down.agg(F.coalesce(F.sum("da"), F.lit(0))).first()[0]
    tasks = max(int(down.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // WEDGES))
    wedges = lists.repartition(tasks, "v", "part").select("v", "part", F.explode("near").alias("w"), "a")
    return wedges.groupBy("v", "part", "w").agg(F.count("*").alias("paths"), F.min("a").alias("least")).drop("part")


def four_cycles(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """One row: the number of 4-cycles, and the first one: x, the least vertex on any; y, the least one opposite to it; a and b, their least common neighbours."""
    edges = written(undirected(edges), "edges")
    pairs = written(opposite_pairs(edges, hub).where("paths > 1"), "pairs")
    count = pairs.agg(F.coalesce(F.sum(F.col("paths") * (F.col("paths") - 1) / 2), F.lit(0)).cast("long").alias("cycles"))
    both = both_ways(edges)
    # The least vertex on a cycle lies before its opposite one or is a common neighbour of two that are.
    on = pairs.agg(F.min(F.least("v", "w", "least")).alias("x"))
    near = both.join(F.broadcast(on), F.col("u") == F.col("x")).select("x", F.col("v").alias("a"))
    wedge = near.join(both.select(F.col("u").alias("a"), F.col("v").alias("y")), "a").where("x <> y")
    far = wedge.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n > 1").groupBy("x").agg(F.min_by(F.struct("y", "a"), "y").alias("p"))
    rest = wedge.join(F.broadcast(far.select("x", F.col("p.y").alias("y"), F.col("p.a").alias("a0"))), ["x", "y"]).where("a > a0")
    first = rest.groupBy("x", "y", F.col("a0").alias("a")).agg(F.min("a").alias("b"))
    return count.join(first, F.lit(True), "left")  # one row with one row
