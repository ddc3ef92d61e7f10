"""Mixing sources to target weights with DataFrame operations only.

Each source's documents fall into blocks by a hash, which is a random permutation of them. A source's target fixes its
quota of blocks: every block once for each whole pass over the source, then a prefix of the blocks, of which the last is cut
at a document, so that at least the longest document's length, or FILL words, is left. The rest is filled from the documents
after it in their order: those that do not fit are skipped. Where this misses the target by more than CLOSE of it, which takes a
small source, the longest of these last ones go first. Where more than 2 * FILL words are left, prefixes are taken first of the
documents of at most a 32nd of it, as rules (size, place); this happens only next to a document (or copies of one) of more than
FILL words, and concerns at most as many words. One more document is added if the sum comes nearer by it. So in the end a
source's words are off its target by less than the shortest document left out.

The quotas of all sources are split among the output shards by a tree: at each node every source's count for the left half is a
draw from the hypergeometric distribution given what the sources before it have drawn, so a node's halves have exact sizes and a
shard holds each source in the proportion that a random shuffle would give. The sources are drawn in groups of GROUP, first each
group's sum, then the sources of each group, so that no row holds more than GROUP of them or one number for each group. Each
shard then draws its own run of each source's permuted blocks, disjoint from those of others, and its documents are shuffled
within the shard. Sources are ranked and targets found by prefix sums over ranges, so no task holds all sources.

Nulls: a null source is a source of its own, last in order; a null text has size 0; a null doc_id is hashed as empty.
Repeated rows (same doc_id and text) have one hash and are counted: at the edge as many of them are taken as fit, which are then
told apart by their numbers in the table; where they differ in further columns, which of them are taken depends on the table's
files. Sources without words have the target 0. A document longer than its source's target is left out of the prefix and taken
only if the sum comes nearer by it; the sum is then off by less than the longest document. An empty table gives an empty table. Further columns are kept; clashing names
cannot occur, since the plan's own columns are prefixed with `_mix_` until the end. Nothing depends on partitioning: reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch

#: Blocks of a source; output shards; weights by the sources' order, repeating; share of all words; most passes over a source.
BLOCKS, SHARDS, WEIGHTS, SHARE, PASSES = 1024, 16, (3, 1, 2), 1.5, 2
#: Plans of up to so many rows (about 60 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Share of a target by which documents in random order may miss it; beyond that, the longest of the last ones go first.
CLOSE = 0.001
#: Words that are filled by document; more than twice as many are taken by prefixes first.
FILL = 1 << 14
#: Sources that are drawn in one row, and standard deviations of a draw beyond which nothing is looked for (less than 1e-30).
GROUP, WIDE = 256, 12
#: Words of the mix for a task that writes it (about 100 MB).
TASK_WORDS = 1 << 24
_RULES = "array<struct<most:bigint,upto:string>>"
#: Documents taken one by one: how many of the copies at a place, null for all.
_EXTRA = "array<struct<place:string,copies:bigint>>"
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """Hash of the parts as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _place(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("")), F.xxhash64(text).cast("string")))


def _block(place: Column, blocks: int) -> Column:
    return (F.conv(F.substring(place, 1, 8), 16, 10).cast("long") * blocks / F.lit(16**8)).cast("long").cast("int")


def _before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with the sums over all rows before each one in this order; only numbers of whole ranges meet in one task."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    by = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    whole = whole.select("_range", *(F.coalesce(F.sum(f"_{k}").over(by), F.lit(0)).alias(f"_{k}") for k in sums))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = ranged.join(whole, "_range")
    return x.select(*rows.columns, *((F.col(f"_{k}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(k) for k, c in sums.items()))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size) with rank and target: share of all words by weight, none above passes times its size."""
    x = _before(sizes, [F.col("source").isNull(), F.col("source")], rank=F.lit(1)).withColumn("rank", F.col("rank").cast("int"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    x = x.withColumn("_weight", weight).withColumn("_cap", (passes * F.col("source_size")).cast("double")).withColumn("_at", F.col("_cap") / F.col("_weight"))
    x = cut(_before(x, [F.col("_at"), F.col("rank")], full=F.col("_cap"), held=F.col("_weight")), "mix-levels")
    total, weighs = x.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("_weight")).first()
    level = (F.lit(float(share) * total) - F.col("full")) / (F.lit(weighs).cast("double") - F.col("held"))
    least = x.where(level <= F.col("_at")).agg(F.min(F.struct("_at", "rank", level.alias("level")))["level"]).first()[0]
    goal = F.col("_cap") if least is None else F.least(F.col("_cap"), F.col("_weight") * F.lit(least))
    return x.select("source", "source_size", "rank", goal.alias("target"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Quantile u of the number of marked among drawn of total, by the ratios of neighbouring probabilities."""
    d = lambda c: c.cast("double")
    mean = d(drawn) * d(marked) / F.greatest(d(total), F.lit(1.0))
    far = WIDE * F.sqrt(mean * (1 - d(marked) / F.greatest(d(total), F.lit(1.0)))) + 50
    least = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), (mean - far).cast("long"))
    most = F.least(marked, drawn, (mean + far).cast("long"))
    step = lambda k: F.log(d(marked - k)) + F.log(d(drawn - k)) - F.log(d(k + 1)) - F.log(d(total - marked - drawn + k + 1))
    walk = F.sequence(least, most - 1)
    start = lambda top: F.struct(F.lit(0.0).alias("w"), F.exp(-top).alias("sum"), least.alias("x"))

    def add(top: Column, aim: Column | None = None):
        def one(a: Column, k: Column) -> Column:
            w = a["w"] + step(k)
            x = a["x"] if aim is None else F.when(a["sum"] < aim, k + 1).otherwise(a["x"])
            return F.struct(w.alias("w"), (a["sum"] + F.exp(w - top)).alias("sum"), x.alias("x"))

        return one

    highest = F.aggregate(
        walk,
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("top")),
        lambda a, k: F.struct((a["w"] + step(k)).alias("w"), F.greatest(a["top"], a["w"] + step(k)).alias("top")),
        lambda a: a["top"],
    )
    found = _let(highest, lambda top: _let(F.aggregate(walk, start(top), add(top), lambda a: a["sum"]) * u, lambda aim: F.aggregate(walk, start(top), add(top, aim), lambda a: a["x"])))
    return F.when(most <= least, least).otherwise(found)


def _left(total: Column, size: Column, name: str, *more: str) -> Column:
    """How many of each of the numbers in held, total in all, are among size drawn; name and more tell the random numbers apart."""

    def draw(a: Column, x: Column) -> Column:
        u = _unit(F.lit(name), *(F.col(c).cast("string") for c in ("first", "last", *more)), F.size(a["left"]).cast("string"))
        took = lambda got: F.struct((a["total"] - x).alias("total"), (a["size"] - got).alias("size"), F.array_append(a["left"], got).alias("left"))
        return _let(_hypergeometric(a["total"], x, a["size"], u), took)

    empty = F.array().cast("array<bigint>")
    return F.aggregate("held", F.struct(total.alias("total"), size.alias("size"), empty.alias("left")), draw, lambda a: a["left"])


def _halves(nodes: DataFrame, *more: str) -> DataFrame:
    """Both halves of nodes whose left half's numbers are in left."""
    right = F.zip_with("held", "left", lambda a, b: a - b)
    kept = [F.col(c) for c in more]
    halves = F.array(F.struct("first", F.col("middle").alias("last"), *kept, F.col("left").alias("held")), F.struct(F.col("middle").alias("first"), "last", *kept, right.alias("held")))
    return nodes.select(F.inline(halves))


def split_quotas(quotas: DataFrame, shards: int = SHARDS, group: int = GROUP) -> DataFrame:
    """(rank, quota), one row a source, to (shard, rank, quota): the splitting tree, a level at a time."""
    ordered = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda s: s["quota"])
    ends = F.lit(0).alias("first"), F.lit(shards).alias("last")
    parts = quotas.withColumn("group", F.floor(F.col("rank") / group).cast("int")).groupBy("group").agg(ordered("rank", "quota").alias("held"), F.sum("quota").alias("quota"))
    parts = cut(parts, "mix-groups")
    top, parts = parts.agg(ordered("group", "quota").alias("held")).select(*ends, "held"), parts.select(*ends, "group", "held")
    middle = ((F.col("first") + F.col("last")) / 2).cast("int")
    sum_ = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    done = []
    span = 1
    while span < shards:
        done.append(parts.where("last - first = 1"))
        open_ = top.where("last - first > 1").withColumn("middle", middle).withColumn("total", sum_("held"))
        size = F.round(F.col("total") * (F.col("middle") - F.col("first")) / (F.col("last") - F.col("first"))).cast("long")
        open_ = open_.withColumn("left", _left(F.col("total"), size, "split"))
        open_ = cut(open_, "mix-top") if span == 1 or 2 * span >= shards else open_
        drawn = open_.select("first", "last", "middle", F.posexplode("left").alias("group", "drawn"))
        parts = parts.join(drawn, ["first", "last", "group"]).withColumn("left", _left(sum_("held"), F.col("drawn"), "group", "group"))
        parts = cut(_halves(parts, "group"), "mix-groups")
        top = _halves(open_)
        span *= 2
    parts = reduce(DataFrame.unionByName, done, parts.select("first", "last", "group", "held"))
    return parts.select(F.col("first").alias("shard"), "group", F.posexplode("held").alias("rank", "quota")).select("shard", (F.col("group") * group + F.col("rank")).alias("rank"), "quota")


def _prefix(rows: DataFrame) -> DataFrame:
    """(rank, last, words): the longest prefix of each rank's rows (rank, place, size, limit) by place of at most limit words.

    Places are summed by their first 20 bits first, so that a task sorts only the rows of one such part."""
    rows = rows.withColumn("part", F.conv(F.substring("place", 1, 5), 16, 10).cast("int"))
    by = Window.partitionBy("rank").orderBy("part")
    parts = rows.groupBy("rank", "limit", "part").agg(F.sum("size").alias("words"), F.max("place").alias("most"))
    parts = cut(parts.withColumn("end", F.sum("words").over(by)).withColumn("begin", F.col("end") - F.col("words")), "mix-parts")
    whole = parts.where("end <= limit").groupBy("rank").agg(F.max("most").alias("most"), F.max("end").alias("end"))
    edge = parts.where("begin <= limit AND end > limit").select("rank", "part", "begin")
    inner = rows.join(edge, ["rank", "part"]).groupBy("rank", "place", "begin", "limit").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("rank").orderBy("place")) + F.col("begin")
    inner = inner.withColumn("upto", upto).where("upto <= limit").groupBy("rank").agg(F.max("place").alias("place"), F.max("upto").alias("upto"))
    return whole.join(inner, "rank", "full_outer").select("rank", F.coalesce("place", "most").alias("last"), F.coalesce("upto", "end").alias("words"))


def _taken(rules: Column, size: Column, place: Column) -> Column:
    """Whether a rule takes a document."""
    return F.exists(rules, lambda r: (size <= r["most"]) & (place <= r["upto"]))


def narrow_gaps(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (source, rank, at, last, target, gap) with rules, and what the documents that those take leave of the gap.

    While a gap is more than 2 * FILL words, a prefix is taken of the documents after the edge that have at most a 32nd of it."""
    edges = edges.withColumn("rules", F.array().cast(_RULES)).withColumn("open", F.lit(True))
    while not edges.where(F.col("open") & (F.col("gap") > 2 * FILL)).isEmpty():
        wide = edges.where(F.col("open") & (F.col("gap") > 2 * FILL)).withColumn("most", F.floor(F.col("gap") / 32)).withColumn("limit", F.col("gap") - F.col("most"))
        after = F.coalesce(F.try_element_at("rules", F.lit(-1))["upto"], F.col("last"), F.lit(""))
        same = F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.block") >= F.col("e.at")) & (F.col("d.place") > F.col("e.after")) & (F.col("d.size") <= F.col("e.most")) & (F.col("d.size") > 0)
        rows = docs.alias("d").join(wide.withColumn("after", after).alias("e"), same).select("rank", "d.place", "d.size", "limit")
        x = edges.join(wide.select("rank", "most"), "rank", "left").join(_prefix(rows).withColumnRenamed("last", "upto"), "rank", "left")
        found = F.col("upto").isNotNull()
        rules = F.when(found, F.array_append("rules", F.struct("most", "upto"))).otherwise(F.col("rules"))
        # Where the small documents do not last, there is nothing more to take by prefixes.
        more = F.col("most").isNotNull() & found & (F.col("words") > 0)
        edges = cut(x.select("source", "rank", "at", "last", "target", (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"), rules.alias("rules"), more.alias("open")), "mix-rules")
    return edges.drop("open")


def fill(docs: DataFrame, edges: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(rank, block, extra): documents after a source's edge (at, last), less those taken by rules, that fill its gap, by block.

    First fit in the order of places, or of lengths where this does not come close. Of documents of lengths within a power of two, only those up to the gap's words are
    looked at, since not all of them can fit; what remains is then less than twice the shortest document left, so that one
    more, sought among all, is the last that can fit."""
    after = F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.block") >= F.col("e.at"))
    x = docs.alias("d").join(edges.alias("e"), after).where("size > 0 AND size < 2 * gap AND (last IS NULL OR place > last)").where(~_taken(F.col("rules"), F.col("size"), F.col("place")))
    x = cut(x.groupBy("rank", "gap", "target", "d.block", "place", "size").agg(F.count("*").alias("copies")).withColumn("kind", F.length(F.bin("size"))), "mix-fits")
    fits, words = x.where("size <= gap"), F.sum(F.col("size") * F.col("copies"))
    by = Window.partitionBy("rank", "kind").orderBy("block")
    near = fits.groupBy("rank", "gap", "kind", "block").agg(words.alias("words")).withColumn("before", F.sum("words").over(by) - F.col("words"))
    within = Window.partitionBy("rank", "kind", "block").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = fits.join(near.where("before < gap").select("rank", "kind", "block", "before"), ["rank", "kind", "block"])
    near = near.withColumn("before", F.col("before") + F.coalesce(words.over(within), F.lit(0))).where("before < gap")
    lists = near.groupBy("rank", "gap", "target").agg(F.sort_array(F.collect_list(F.struct("place", "size", "copies"))).alias("docs"))

    def take(a: Column, d: Column) -> Column:
        fit = F.least(d["copies"], F.floor(a["left"] / d["size"])).cast("long")
        more = F.struct((a["left"] - fit * d["size"]).alias("left"), F.array_append(a["took"], F.struct(d["place"].alias("place"), d["size"].alias("size"), fit.alias("took"), d["copies"].alias("copies"))).alias("took"))
        return F.when(d["size"] <= a["left"], more).otherwise(a)

    start = F.struct(F.col("gap").cast("double").alias("left"), F.array().cast("array<struct<place:string,size:bigint,took:bigint,copies:bigint>>").alias("took"))
    longest = F.array_sort("docs", lambda d, e: F.when(d["size"] > e["size"], -1).when(d["size"] < e["size"], 1).when(d["place"] < e["place"], -1).otherwise(1))
    lists = lists.withColumn("a", F.aggregate("docs", start, take)).withColumn("b", F.aggregate(longest, start, take))
    better = (F.col("a.left") > CLOSE * F.col("target")) & (F.col("b.left") < F.col("a.left"))
    lists = cut(lists.select("rank", F.when(better, F.col("b")).otherwise(F.col("a")).alias("a")).select("rank", "a.left", "a.took"), "mix-took")
    took = lists.select("rank", F.inline("took"))
    left = x.join(lists.select("rank", "left"), "rank", "left").withColumn("left", F.coalesce("left", "gap")).withColumn("off", F.abs(F.col("size") - F.col("left"))).where("off < left")
    left = left.join(took.select("rank", "place", "size", "took"), ["rank", "place", "size"], "left").where("took IS NULL OR took < copies")
    more = left.groupBy("rank").agg(F.min(F.struct("off", "place", "size", "copies")).alias("m")).select("rank", "m.place", "m.size", F.lit(1).cast("long").alias("took"), "m.copies")
    extra = took.unionByName(more).groupBy("rank", "place", "size", "copies").agg(F.sum("took").alias("took"))
    extra = extra.select("rank", _block(F.col("place"), blocks).alias("block"), F.struct("place", F.when(F.col("took") < F.col("copies"), F.col("took")).alias("copies")).alias("e"))
    return extra.groupBy("rank", "block").agg(F.sort_array(F.collect_list("e")).alias("extra"))


def mixing_plan(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source and block: source_size, target, and draws, an array of (pass, shard, last, extra, rules).

    last is null where the whole block is drawn, else documents are drawn up to this place, those at the places of extra (so many
    copies, or all), and those that a rule takes."""
    narrow = cut(docs.select("source", word_count(F.col("text")).alias("size"), _place(F.col("doc_id"), F.col("text")).alias("place")), "mix")
    narrow = narrow.withColumn("block", _block(F.col("place"), blocks))
    held = cut(narrow.groupBy("source", "block").agg(F.sum("size").alias("words"), F.max("size").alias("longest")), "mix-blocks")
    goal = targets(held.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, passes)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    same = F.col("h.source").eqNullSafe(F.col("g.source"))
    x = held.alias("h").join(goal.alias("g"), same).select("h.source", "h.block", "h.words", "h.longest", "g.source_size", "g.target", "g.rank", "g.whole", "g.rest")
    by = Window.partitionBy("rank").orderBy("block")
    x = x.withColumn("end", F.sum("words").over(by)).withColumn("begin", F.col("end") - F.col("words")).withColumn("place_in", F.row_number().over(by) - 1)
    room = F.least(F.max("longest").over(Window.partitionBy("rank")), F.lit(FILL))
    x = x.withColumn("until", F.greatest(F.col("rest") - room, F.lit(0.0)))
    x = x.withColumn("state", F.when(F.col("end") <= F.col("until"), 2).when((F.col("begin") <= F.col("until")) & (F.col("rest") > 0), 1).otherwise(0))
    x = cut(x, "mix-spans")
    # The block in which a source's rest ends is cut at a document; documents after it fill what is left.
    edge = x.where("state = 1").select("source", "rank", F.col("block").alias("at"), "begin", "until", "rest", "target")
    inner = narrow.alias("n").join(edge.alias("e"), F.col("n.source").eqNullSafe(F.col("e.source")) & (F.col("n.block") == F.col("e.at")))
    first = _prefix(inner.select("rank", "place", "size", (F.col("until") - F.col("begin")).alias("limit")))
    edge = edge.join(first, "rank", "left").select("source", "rank", "at", "last", "target", (F.col("rest") - F.col("begin") - F.coalesce("words", F.lit(0))).alias("gap"))
    edge = narrow_gaps(narrow, cut(edge, "mix-gaps"))
    extra = fill(narrow, edge, blocks)
    far = _block(F.try_element_at("rules", F.lit(-1))["upto"], blocks)
    ruled = edge.where(F.size("rules") > 0).select("rank", F.col("at").alias("from"), far.alias("far"), "rules")
    x = x.join(edge.select("rank", "last"), "rank", "left").join(extra, ["rank", "block"], "left").join(ruled, "rank", "left")
    x = x.withColumn("last", F.when(F.col("state") == 1, F.col("last"))).withColumn("rules", F.when((F.col("block") >= F.col("from")) & (F.col("block") <= F.col("far")), F.col("rules")))
    some = F.col("last").isNotNull() | F.col("extra").isNotNull() | F.col("rules").isNotNull()
    x = cut(x.withColumn("state", F.when(F.col("state") == 2, 2).when(some, 1).otherwise(0)), "mix-states")
    passes_of = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(passes)), lambda p: F.when(p < F.col("whole"), p).when((p == F.col("whole")) & (F.col("state") > 0), p)))
    draws = x.withColumn("pass", F.explode(passes_of))
    part = lambda c, none: F.when((F.col("state") == 1) & (F.col("pass") == F.col("whole")), F.coalesce(c, none)).alias(c)
    draws = draws.select("rank", "block", "place_in", "pass", part("last", F.lit("")), part("extra", F.array().cast(_EXTRA)), part("rules", F.array().cast(_RULES)))
    draws = draws.withColumn("turn", F.row_number().over(Window.partitionBy("rank").orderBy("pass", "place_in")) - 1)
    quotas = goal.select("rank").join(draws.groupBy("rank").agg(F.count("*").alias("quota")), "rank", "left").select("rank", F.coalesce("quota", F.lit(0)).alias("quota"))
    shares = cut(split_quotas(quotas, shards), "mix-shares")
    shares = shares.withColumn("to", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))).withColumn("from", F.col("to") - F.col("quota"))
    placed = draws.join(shares, "rank").where((F.col("turn") >= F.col("from")) & (F.col("turn") < F.col("to")))
    placed = placed.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "last", "extra", "rules"))).alias("draws"))
    none = F.array().cast(f"array<struct<pass:int,shard:int,last:string,extra:{_EXTRA},rules:{_RULES}>>")
    return x.select("source", "block", "source_size", "target", "rank").join(placed, ["rank", "block"], "left").withColumn("draws", F.coalesce("draws", none)).drop("rank")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """docs with size, source_size, target, taken and draws (pass, shard) of each document."""
    with scratch() as keep:
        plan = keep(cut(mixing_plan(docs, **settings), "mix-plan"))
    return _mixed(docs, plan, settings.get("blocks", BLOCKS))


def _numbered(own: DataFrame) -> DataFrame:
    """own with the numbers from 1 of equal rows of which only some are drawn; those rows are written, and none else is moved.

    Numbers run through the parts in which the rows were written, so no task holds more of them than were read by one."""
    place = F.col("_mix_place")
    # Draws of whole blocks have no extra, so the inner answer may be null.
    one = lambda d: F.coalesce(F.exists(d["extra"], lambda e: (e["place"] == place) & e["copies"].isNotNull()), F.lit(False))
    some = F.exists("_mix_draws", one)
    rows = cut(own.where(some).withColumn("_mix_row", F.monotonically_increasing_id()), "mix-copies")
    rows = rows.withColumn("_mix_part", F.shiftright("_mix_row", 33))
    parts = rows.groupBy("_mix_source", "_mix_place", "_mix_part").agg(F.count("*").alias("_mix_held"))
    by = Window.partitionBy("_mix_source", "_mix_place").orderBy("_mix_part")
    parts = parts.select(F.col("_mix_source").alias("_mix_s"), F.col("_mix_place").alias("_mix_p"), F.col("_mix_part").alias("_mix_q"), (F.sum("_mix_held").over(by) - F.col("_mix_held")).alias("_mix_before"))
    same = F.col("_mix_source").eqNullSafe(F.col("_mix_s")) & (place == F.col("_mix_p")) & (F.col("_mix_part") == F.col("_mix_q"))
    within = Window.partitionBy("_mix_source", "_mix_place", "_mix_part").orderBy("_mix_row")
    number = (F.row_number().over(within) + F.col("_mix_before")).alias("_mix_number")
    return own.where(~some).withColumn("_mix_number", F.lit(None).cast("long")).unionByName(rows.join(parts, same).select(*own.columns, number))


def _mixed(docs: DataFrame, plan: DataFrame, blocks: int) -> DataFrame:
    plan = plan.select(*(F.col(c).alias(f"_mix_{c}") for c in plan.columns))
    some = F.exists("_mix_draws", lambda d: F.exists(d["extra"], lambda e: e["copies"].isNotNull()))
    rows, split = plan.agg(F.count("*"), F.coalesce(F.bool_or(some), F.lit(False))).first()
    if rows <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    own = docs.withColumn("_mix_place", _place(F.col("doc_id"), F.col("text"))).withColumn("_mix_size", word_count(F.col("text")))
    own = own.join(plan, F.col("source").eqNullSafe(F.col("_mix_source")) & (_block(F.col("_mix_place"), blocks) == F.col("_mix_block")))
    own = _numbered(own) if split else own.withColumn("_mix_number", F.lit(None).cast("long"))
    place, size, number = F.col("_mix_place"), F.col("_mix_size"), F.col("_mix_number")
    one = lambda d: F.exists(d["extra"], lambda e: (e["place"] == place) & (e["copies"].isNull() | (number <= e["copies"])))
    taken = F.filter("_mix_draws", lambda d: d["last"].isNull() | (place <= d["last"]) | one(d) | _taken(d["rules"], size, place))
    draws = F.transform(taken, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard")))
    more = {"size": size, "source_size": F.col("_mix_source_size"), "target": F.col("_mix_target"), "taken": size * F.size(draws), "draws": draws}
    own = own.withColumns({f"_mix_out_{k}": v for k, v in more.items()})
    return own.select(*docs.columns, *(F.col(f"_mix_out_{k}").alias(k) for k in more), F.col("_mix_place").alias("place"))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: documents as often as they were drawn, those of a shard together and shuffled within it."""
    inner = docs.select(*(F.col(c).alias(f"_in_{c}") if c not in ("doc_id", "text", "source") else F.col(c) for c in docs.columns))
    with scratch() as keep:
        plan = keep(cut(mixing_plan(inner, **settings), "mix-plan"))
    x = _mixed(inner, plan, settings.get("blocks", BLOCKS)).withColumn("_draw", F.explode("draws"))
    x = x.withColumn("_order", F.md5(F.concat_ws("|", "place", F.col("_draw.pass").cast("string")))).withColumn("_shard", F.col("_draw.shard"))
    # A shard's documents are dealt to as many tasks as its words need, each a run of its shuffled order.
    shards = settings.get("shards", SHARDS)
    words = plan.select("source", "target").distinct().agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    runs = max(16, int(words / TASK_WORDS / shards) + 1)
    run = (F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * runs / F.lit(16**8)).cast("long")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(words / TASK_WORDS) + 1)
    x = x.repartition(tasks, "_shard", run).sortWithinPartitions("_shard", "_order")
    return x.select(*(F.col(f"_in_{c}").alias(c) if c not in ("doc_id", "text", "source") else F.col(c) for c in docs.columns))
