"""Isomorphism classes of many small graphs, by colour refinement over tables and branching only where symmetry is left.

Graphs are rows of edges (graph, u, v) and vertices (graph, vertex, colour); an isomorphism keeps colours. Leaves go first: a vertex's text
counts those at it by colour, which settles all that are stars or single vertices. What is left of each graph is cut into its
components, whose forms, sorted together with those of the settled vertices, are the graph's form. All components are refined at once: a vertex's next colour is a digest of its own
and its neighbours' sorted colours, so equal colours mean the same in every graph, and rounds go on until no colour class splits. Vertices
of one colour with the same neighbours can change places freely and are told apart by numbers. Components in which two vertices still
share a colour are copied, once for each vertex of their first smallest class, which gets a colour of its own; this goes on until all
colours differ. A copy's form lists colours and edges by the rank of their vertices' colours, and the least of its copies is the
component's. Equal forms are isomorphic, since a form is the graph itself; isomorphic graphs have equal forms, since no step looks at names.

Work grows with the copies: as many as a component has symmetries that swapping equal neighbours does not give, not with all its
relabelings. Loops, repeated edges and repeated vertices count once; an edge's ends need no row of their own, their colour is then
null. A component must fit a cell as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planarflow.operators.graphs import both_ways, components, undirected
from planarflow.sources.folders import written

PIECE = ["graph", "piece"]
COPY = [*PIECE, "copy"]


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _refined(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices (copy, vertex, colour) with stable colours."""
    classes = lambda x: x.select(*COPY, "colour").distinct().count()
    have = classes(vertices)
    while True:
        seen = edges.withColumnRenamed("v", "vertex").join(vertices, [*PIECE, "vertex"]).groupBy(*COPY, F.col("u").alias("vertex")).agg(F.array_join(F.sort_array(F.collect_list("colour")), ",").alias("_near"))
        new = vertices.join(seen, [*COPY, "vertex"], "left").withColumn("colour", _digest(F.col("colour"), F.coalesce("_near", F.lit("")))).drop("_near")
        new = written(new, "colours")
        now = classes(new)
        if now == have:
            return vertices
        vertices, have = new, now


def _twins_apart(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Number the vertices of one colour whose neighbours are the same, or are the same but for each other."""
    near = edges.groupBy(*PIECE, F.col("u").alias("vertex")).agg(F.collect_list("v").alias("_v"))
    for own in (False, True):
        around = F.coalesce("_v", F.array().cast("array<long>"))
        name = F.array_join(F.sort_array(F.array_append(around, F.col("vertex")) if own else around), ",")
        x = vertices.join(near, [*PIECE, "vertex"], "left").withColumn("_name", name)
        place = F.row_number().over(Window.partitionBy(*COPY, "colour", "_name").orderBy("vertex"))
        alike = F.count("*").over(Window.partitionBy(*COPY, "colour", "_name"))
        vertices = x.withColumns({"_place": place, "_alike": alike}).withColumn("colour", F.when(F.col("_alike") > 1, _digest(F.col("colour"), F.col("_place").cast("string"))).otherwise(F.col("colour"))).drop("_v", "_name", "_place", "_alike")
    return written(vertices, "colours")


def _branched(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies whose colours all differ, and those of the others with one vertex singled out."""
    sizes = vertices.groupBy(*COPY, "colour").agg(F.count("*").alias("_n"))
    pick = sizes.where("_n > 1").groupBy(*COPY).agg(F.min(F.struct("_n", "colour")).alias("_p")).select(*COPY, F.col("_p.colour").alias("_pick"))
    pick = written(pick, "picks")
    done = vertices.join(pick, COPY, "left_anti")
    open_ = vertices.join(pick, COPY)
    chosen = open_.where(F.col("colour") == F.col("_pick")).select(*COPY, F.col("vertex").alias("_one"))
    out = open_.join(chosen, COPY).withColumn("colour", F.when(F.col("vertex") == F.col("_one"), _digest(F.col("colour"), F.lit("*"))).otherwise(F.col("colour")))
    return done, written(out.withColumn("copy", F.concat_ws(".", "copy", F.col("_one").cast("string"))).drop("_pick", "_one"), "copies")


def _forms(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The least form of each piece's copies."""
    ranked = vertices.withColumn("rank", F.row_number().over(Window.partitionBy(*COPY).orderBy("colour")))
    ends = edges.where("u > v").join(ranked.select(*COPY, F.col("vertex").alias("u"), F.col("rank").alias("a")), [*PIECE, "u"]).join(ranked.select(*COPY, F.col("vertex").alias("v"), F.col("rank").alias("b")), [*COPY, "v"])
    lines = ends.groupBy(*COPY).agg(F.sort_array(F.collect_list(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))).alias("_e"))
    names = ranked.groupBy(*COPY).agg(F.sort_array(F.collect_list(F.struct("rank", "given"))).alias("_c"))
    text = F.concat_ws("|", F.array_join(F.transform("_c", lambda c: c["given"]), ","), F.array_join(F.transform(F.coalesce("_e", F.array()), lambda e: F.concat_ws("-", e["a"], e["b"])), ","))
    return names.join(lines, COPY, "left").withColumn("form", text).groupBy(*PIECE).agg(F.min("form").alias("form"))


def _folded(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (graph, vertex, given, busy) without the leaves, which the given text of their only neighbour counts by colour, and the edges that are left.

    Of two vertices that only meet each other, the one with the lesser text stays. A vertex is busy if edges are left to it."""
    ends = both_ways(edges, ["graph"]).select("graph", F.col("u").alias("vertex"), F.col("v").alias("near"), F.lit(1).alias("degree"), F.lit(None).cast("string").alias("colour"))
    named = vertices.select("graph", "vertex", F.lit(None).cast("long").alias("near"), F.lit(0).alias("degree"), F.col("colour").cast("string").alias("colour"))
    known = ends.unionByName(named).groupBy("graph", "vertex").agg(F.sum("degree").alias("degree"), F.max("near").alias("near"), F.min("colour").alias("colour"))
    known = written(known.withColumn("given", F.coalesce(F.concat(F.lit("c"), F.hex("colour")), F.lit("n"))).drop("colour"), "ends")
    # Leaves of one colour are counted before they meet, so a hub's are gathered nowhere.
    leaves = known.where("degree = 1").groupBy("graph", F.col("near").alias("vertex"), F.col("given").alias("leaf")).agg(F.count("*").alias("n"))
    held = leaves.groupBy("graph", "vertex").agg(F.sort_array(F.collect_list(F.struct("leaf", "n"))).alias("_held"), F.sum("n").alias("_folded"))
    x = known.join(held, ["graph", "vertex"], "left")
    first = F.col("_held").isNotNull() & (F.struct("given", "vertex") < F.struct(F.col("_held")[0]["leaf"], F.col("near")))
    text = F.concat("given", F.lit("("), F.array_join(F.transform("_held", lambda h: F.concat_ws(":", h["leaf"], h["n"])), "."), F.lit(")"))
    core = x.where((F.col("degree") != 1) | first).select("graph", "vertex", F.coalesce(text, "given").alias("given"), (F.col("degree") > F.coalesce("_folded", F.lit(0))).alias("busy"))
    core = written(core, "core")
    busy = core.where("busy")
    for end in ("u", "v"):
        edges = edges.join(busy.select("graph", F.col("vertex").alias(end)), ["graph", end], "left_semi")
    return core, written(edges.select("graph", "u", "v"), "core-edges")


def graph_forms(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph and form; graphs with equal forms are isomorphic, and no others."""
    core, edges = _folded(vertices, written(undirected(edges, ["graph"]), "edges"))
    forms = core.where("not busy").select("graph", F.concat_ws("|", "given", F.lit("")).alias("form"))
    parts = components(edges, ["graph"]).withColumnRenamed("component", "piece")
    whole = core.where("busy").select("graph", "vertex", "given").join(parts, ["graph", "vertex"])
    open_ = written(whole.withColumns({"colour": F.col("given"), "copy": F.lit("")}), "vertices")
    lines = written(both_ways(edges, ["graph"]).join(open_.select("graph", "piece", F.col("vertex").alias("u")), ["graph", "u"]), "lines")
    closed = None
    while not open_.isEmpty():
        open_ = _refined(_twins_apart(_refined(open_, lines), lines), lines)
        done, open_ = _branched(open_)
        done = written(done, "labelled")
        closed = done if closed is None else closed.unionByName(done)
    if closed is not None:
        forms = forms.unionByName(_forms(closed, lines).select("graph", "form"))
    return forms.groupBy("graph").agg(F.array_join(F.sort_array(F.collect_list("form")), ";").alias("form"))
