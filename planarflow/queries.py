"""Queries of the drawing engine, by name, and the SQL that checks them.

kmn_*, k22_*, dual_routes_* and census_* are the engine's own operators; the census ones are held against published numbers.
stat_* and text_* apply the diagnostics' and the flags' relational operators to the given tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarflow.functions import canonical, formats
from planarflow.functions.drawing import Extender, check, relabel, seeds
from planarflow.operators import census, diagnostics, flags, profile, stored
from planarflow.plans import graph
from planarflow.plans.golden import COUNTS
from planarflow.sources import codec, files
from planarflow.sources.folders import new_folder, written
from planarflow.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLE_SQL[name or f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- K(m,n) ---------------------------------------------------------------------------------------


def graphs(spark: SparkSession) -> DataFrame:
    """m and n of all graphs of the census."""
    m, n = spark.range(2, 5).withColumnRenamed("id", "m"), spark.range(2, 7).withColumnRenamed("id", "n")
    return m.join(n, (F.col("m") <= F.col("n")) & (F.col("m") + F.col("n") <= 8))


def all_edges(spark: SparkSession) -> DataFrame:
    a, b = spark.range(0, 8).withColumnRenamed("id", "a"), spark.range(0, 8).withColumnRenamed("id", "b")
    x = graphs(spark).join(a, F.col("a") < F.col("m")).join(b, (F.col("b") >= F.col("m")) & (F.col("b") < F.col("m") + F.col("n")))
    return x.withColumn("edge_id", F.col("a") * F.col("n") + F.col("b") - F.col("m"))


_EDGES = """g AS (SELECT m.range AS m, n.range AS n FROM range(2, 5) m JOIN range(2, 7) n ON m.range <= n.range AND m.range + n.range <= 8),
e AS (SELECT m, n, a.range AS a, b.range AS b, a.range * n + b.range - m AS edge_id FROM g JOIN range(0, 8) a ON a.range < m JOIN range(0, 8) b ON b.range >= m AND b.range < m + n),
x AS (SELECT e.m, e.n, e.a AS a1, e.b AS b1, f.a AS a2, f.b AS b2 FROM e JOIN e f ON e.m = f.m AND e.n = f.n AND e.edge_id < f.edge_id AND e.a <> f.a AND e.b <> f.b)"""


@query(f"WITH {_EDGES} SELECT m, n, edge_id, a, b FROM e")
def kmn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_edges(spark).select("m", "n", "edge_id", "a", "b")


def disjoint_pairs(edges: DataFrame) -> DataFrame:
    """Pairs of edges of a graph without a common end: its possible crossings."""
    e, f = edges.alias("e"), edges.alias("f")
    same = (F.col("e.m") == F.col("f.m")) & (F.col("e.n") == F.col("f.n")) & (F.col("e.edge_id") < F.col("f.edge_id"))
    x = e.join(f, same & (F.col("e.a") != F.col("f.a")) & (F.col("e.b") != F.col("f.b")))
    return x.select("e.m", "e.n", F.col("e.a").alias("a1"), F.col("e.b").alias("b1"), F.col("f.a").alias("a2"), F.col("f.b").alias("b2"))


@query(f"WITH {_EDGES} SELECT m, n, count(*) AS n_crossings, count(DISTINCT [least(a1, a2), greatest(a1, a2), least(b1, b2), greatest(b1, b2)]) AS n_four_sets FROM x GROUP BY m, n")
def kmn_possible_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.array_sort(F.array("a1", "b1", "a2", "b2"))
    return disjoint_pairs(all_edges(spark)).groupBy("m", "n").agg(F.count("*").alias("n_crossings"), F.countDistinct(four).alias("n_four_sets"))


@query(f"WITH {_EDGES} SELECT m, n, concat(a1 + 1, b1 + 1, a2 + 1, b2 + 1) AS token FROM x")
def kmn_crossing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_labels(spark).select("m", "n", F.col("crossing").alias("token"))


@query(f"WITH {_EDGES} SELECT DISTINCT m, n, concat(least(a1, a2) + 1, greatest(a1, a2) + 1, least(b1, b2) + 1, greatest(b1, b2) + 1) AS token FROM x")
def kmn_four_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_labels(spark).select("m", "n", F.col("four").alias("token")).distinct()


def _all_labels(spark: SparkSession) -> DataFrame:
    """The label tables of all graphs."""
    tables = (flags.label_table(spark, census.census_of(m, n).points).select(F.lit(m).cast("long").alias("m"), F.lit(n).cast("long").alias("n"), "crossing", "four") for m, n in COUNTS)
    return reduce(DataFrame.unionByName, tables)


@query("""WITH g AS (SELECT m.range AS m, n.range AS n FROM range(2, 5) m JOIN range(2, 7) n ON m.range <= n.range AND m.range + n.range <= 8)
SELECT m, n, CAST(factorial(CAST(m AS INTEGER)) * factorial(CAST(n AS INTEGER)) * CASE WHEN m = n THEN 2 ELSE 1 END AS BIGINT) AS n_automorphisms FROM g""")
def kmn_automorphism_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(m, n, len(census.census_of(m, n).group)) for m, n in COUNTS]
    return spark.createDataFrame(rows, "m long, n long, n_automorphisms long")


@query("SELECT * FROM (VALUES ('crossing', '4 0 1 1 2 2 0'), ('crossing', '4 0 1 1 2 2 1 1324'), ('four', '4 0 1 1 2 2 0'), ('four', '4 0 1 1 2 2 1 1234')) t(kind, flag)")
def k22_seed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = census.census_of(2, 2)
    return flags.labeled(flags.exported(census.crossing_sets(census.seed_classes(spark, 2, 2), 2, 2), c)).select("kind", "flag")


@query("""WITH RECURSIVE doors(face, bit, far) AS (VALUES (0, 1, 2), (0, 2, 2), (1, 2, 2), (2, 2, 1), (2, 2, 0), (2, 1, 0)),
goal(face) AS (VALUES (1), (2)),
route(face, used, depth) AS (
  SELECT * FROM (VALUES (0, 0, 0), (1, 0, 0), (2, 0, 0)) s(face, used, depth)
  UNION ALL SELECT d.far, r.used + d.bit, r.depth + 1 FROM route r JOIN doors d ON d.face = r.face AND (r.used & d.bit) = 0)
SELECT depth, count(*) AS n_routes FROM route JOIN goal USING (face) GROUP BY depth""")
def dual_routes_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the first edge of a new vertex through the crossed drawing of K(2,2), by number of crossings."""
    c = census.census_of(2, 3)
    x = Extender(c.points, seeds(c)[1], c.stages[0].steps[0])
    bits = {p: 1 << i for i, p in enumerate(sorted({d[0] for doors in x.doors for d in doors}))}
    doors = [(i, bits[p], far) for i, out in enumerate(x.doors) for p, _, far in out]
    faces = [(i, x.step.target in f) for i, f in enumerate(x.faces)]
    return spark.sql(
        """WITH RECURSIVE route(face, used, depth) AS (
             SELECT face, 0, 0 FROM {faces}
             UNION ALL SELECT d.far, r.used + d.bit, r.depth + 1 FROM route r JOIN {doors} d ON d.face = r.face AND (r.used & d.bit) = 0)
           SELECT depth, count(*) AS n_routes FROM route JOIN {faces} f USING (face) WHERE f.goal GROUP BY depth""",
        doors=spark.createDataFrame(doors, "face int, bit int, far int"),
        faces=spark.createDataFrame(faces, "face int, goal boolean"),
    )


# --- census ---------------------------------------------------------------------------------------


def _sets(spark: SparkSession, m: int, n: int) -> DataFrame:
    return census.crossing_sets(census.classes(spark, m, n), m, n)


def _strong(m: int, n: int):
    return lambda spark, sf_dir: census.strong_classes(_sets(spark, m, n), m, n).select("color_preserving", "color_blind")


def _flag_classes(m: int, n: int, kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = census.census_of(m, n)
        return flags.flag_class_counts(flags.labeled(flags.exported(_sets(spark, m, n), c)), c, kind)

    return run


for _m, _n in ((2, 2), (2, 3), (2, 4), (2, 5), (2, 6), (3, 3), (3, 4)):
    for _kind, _make in (("strong", _strong(_m, _n)), *((k, _flag_classes(_m, _n, k)) for k in flags.KINDS)):
        _kept, _blind = COUNTS[_m, _n][_kind]
        _name = f"census_strong_K{_m}_{_n}" if _kind == "strong" else f"census_{_kind}_flags_K{_m}_{_n}"
        query(f"SELECT CAST({_kept} AS BIGINT) AS color_preserving, CAST({_blind} AS BIGINT) AS color_blind", _name)(_make)


@query("SELECT CAST(27 AS BIGINT) AS fixed_by_side_swap")
def side_swap_K3_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.strong_classes(_sets(spark, 3, 3), 3, 3).select("fixed_by_side_swap")


@query("SELECT * FROM (VALUES ('crossing', 204), ('four', 204)) t(kind, n)")
def exported_rows_K3_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.exported(_sets(spark, 3, 3), census.census_of(3, 3)).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("SELECT CAST(5 AS BIGINT) AS color_preserving, CAST(5 AS BIGINT) AS color_blind")
def streamed_flags_K2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage without drawings: crossing sets alone give the same flag classes."""
    c = census.census_of(2, 3)
    sets = census.final_crossing_sets(spark, census.seed_classes(spark, 2, 3), 2, 3)
    return flags.flag_class_counts(flags.labeled(flags.exported(sets, c)), c, "crossing")


# --- diagnostics' operators on the given tables -----------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stat_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.counts_by(table(spark, sf_dir, "events"), "event_type")


@query("SELECT count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS large_open, count(*) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS early FROM orders")
def stat_count_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    return diagnostics.count_where(table(spark, sf_dir, "orders"), large_open=(F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000), early=early)


@query("""SELECT l_returnflag, count(*) AS n, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS total, min(CAST(l_quantity AS BIGINT)) AS least,
max(CAST(l_quantity AS BIGINT)) AS most, round(avg(CAST(l_quantity AS BIGINT)), 6) AS mean, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem GROUP BY l_returnflag""")
def stat_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return diagnostics.multi_aggregate(x, "l_returnflag", "q", "l_suppkey").withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS total FROM orders GROUP BY ALL")
def stat_sums_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.sums_by(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def stat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def stat_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def stat_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.without(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def stat_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.having(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders").where("o_totalprice > 300000"), "o_custkey")


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open,
(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_filled FROM customer""")
def stat_correlated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    owners = table(spark, sf_dir, "customer").select("c_custkey")
    return diagnostics.with_counts(owners, "c_custkey", orders, "o_custkey", n_open=F.col("o_orderstatus") == "O", n_filled=F.col("o_orderstatus") == "F")


@query("SELECT event_type, user_id, min(props) AS props FROM events GROUP BY event_type, user_id")
def stat_upsert_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.least_payload(table(spark, sf_dir, "events"), ["event_type", "user_id"], "props")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stat_upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def stat_insert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.first_wins(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("SELECT event_type, count(*) AS n, coalesce(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 0) AS k FROM events GROUP BY event_type")
def stat_json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.payload_sums(table(spark, sf_dir, "events"), "props", ["k"], "event_type")


@query("SELECT event_type, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS span_seconds FROM events GROUP BY event_type")
def stat_wall_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last"), F.min("ts").alias("first"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return x.select("event_type", F.round(seconds("last") - seconds("first")).cast("long").alias("span_seconds"))


@query("SELECT n_nationkey, CASE WHEN count(o_orderkey) <> 0 THEN count(*) FILTER (o_orderstatus = 'F') / count(o_orderkey) END AS filled FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey")
def stat_ratio_zero_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9900")
    x = table(spark, sf_dir, "nation").join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    held = x.groupBy("n_nationkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("part"), F.count("o_orderkey").alias("whole"))
    return held.select("n_nationkey", diagnostics.ratio(F.col("part"), F.col("whole")).alias("filled"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL ORDER BY ts, event_id")
def stat_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase") & F.col("value").isNotNull())
    return x.orderBy("ts", "event_id").select("event_id", "event_type")


@query("SELECT coalesce(sum(l_linenumber), 0)::BIGINT AS total, count(*) AS n FROM lineitem WHERE l_quantity < 0")
def stat_empty_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").where("l_quantity < 0")
    return x.agg(F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("total"), F.count("*").alias("n"))


# --- flags' operators on texts ----------------------------------------------------------------------


@query("SELECT DISTINCT text FROM documents ORDER BY text")
def text_sort_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("text").distinct().orderBy("text")


@query("SELECT substr(sha256(text), 1, 2) AS bucket, count(*) AS n, count(DISTINCT text) AS n_texts FROM documents GROUP BY 1")
def text_hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").withColumn("bucket", F.substring(F.sha2("text", 256), 1, 2))
    return x.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ') AS tokens FROM documents")
def text_token_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_sort(F.array_distinct(F.split("text", " ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("tokens"))


# --- exchange formats -------------------------------------------------------------------------------


def _mapped(df: DataFrame, schema: str, make: Callable[..., tuple]) -> DataFrame:
    """make(row's values) for every row, in Arrow batches."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return df.mapInArrow(run, schema)


@query("""SELECT o_orderkey, o_orderkey AS back, CASE WHEN o_orderkey < 128 THEN printf('%02x', o_orderkey) WHEN o_orderkey < 16384 THEN printf('%02x%02x', o_orderkey % 128 + 128, o_orderkey // 128)
ELSE printf('%02x%02x%02x', o_orderkey % 128 + 128, o_orderkey // 128 % 128 + 128, o_orderkey // 16384) END AS varint FROM orders""")
def codec_varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    packed = table(spark, sf_dir, "orders").select(key, formats.varint(key).alias("v"))
    return packed.select(key, F.lower(F.hex("v")).alias("varint"), formats.unvarint(F.col("v")).alias("back"))


@query("SELECT sha256(text) AS record_sha256, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def codec_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts packed into gzip record files and read from them."""
    packed = files.pack_record_files(table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("record")), 100)
    back = files.records_of(packed.select(F.col("name").alias("path"), "content"))
    return back.groupBy(F.sha2("record", 256).alias("record_sha256")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, sha256(c_name) AS report_hash, sha256(c_mktsegment) AS work_hash, c_name AS payload, sha256(c_name) AS bucket, c_mktsegment AS invariant, c_name AS flag, 'fallback' AS bare_bucket, '' AS bare_invariant FROM customer")
def codec_shard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduced, raw and flag records, written and read; a raw record and a flag without their headers."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    payload, hashes = F.encode(name, "utf-8"), (F.sha2(name, 256), F.sha2(segment, 256))
    x = table(spark, sf_dir, "customer").select(
        "c_custkey",
        formats.reduced_parts(formats.reduced(*hashes, payload)).alias("r"),
        formats.raw_parts(formats.raw(hashes[0], payload), F.lit("none")).alias("w"),
        formats.flagged_parts(formats.flagged(hashes[0], segment, name)).alias("f"),
        formats.raw_parts(payload, F.lit("fallback")).alias("bare"),
        formats.flagged_parts(payload).alias("plain"),
    )
    return x.select("c_custkey", "r.report_hash", "r.work_hash", F.decode("r.payload", "utf-8").alias("payload"), F.col("w.bucket_hash").alias("bucket"), "f.invariant", "f.flag", F.col("bare.bucket_hash").alias("bare_bucket"), F.col("plain.invariant").alias("bare_invariant"))


@query("SELECT doc_id, sha256(text) AS digest, base64(encode(text)) AS blob FROM documents")
def codec_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts deflated and inflated, then digested."""
    back = _mapped(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id long, back binary", lambda key, text: (key, None if text is None else codec.inflate(codec.deflate(text.encode()))))
    return back.select("doc_id", F.sha2("back", 256).alias("digest"), F.translate(F.base64("back"), "\r\n", "").alias("blob"))


def _round_trips(m: int, n: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = census.census_of(m, n)
        last = len(c.stages) - 1
        found = census.classes(spark, m, n)
        records = files.compact_records(found, m, n, last)
        back = files.classes_of_records(records, m, n, last)
        joined = found.join(back.withColumn("compact", F.lit(1)), "form", "left")

        def make(form: bytes, text: str, record: bytes) -> tuple:
            d = canonical.unpack(form)
            check(d, c.points)
            s = codec.summary(d, c.points)
            return form, codec.from_json(text, c.points) == d, codec.header(record) == (codec.VERSION, last), s["vertices"], s["edges"], s["crossings"], s["faces"]

        texts = files.json_drawings(found, m, n).join(records, "form")
        schema = "form binary, json boolean, header boolean, vertices long, edges long, crossings long, faces long"
        x = joined.select("form", "compact").join(_mapped(texts.select("form", "json", "record"), schema, make), "form")
        # The planar drawing of K(2,n) lacks the face that coincides with another one. Euler: each crossing adds a vertex and two edges, so faces = edges - vertices + 2 + crossings.
        euler = F.count_if(F.col("faces") == F.col("edges") - F.col("vertices") + 2 + F.col("crossings"))
        return x.agg(F.count("*").alias("classes"), F.count("compact").alias("compact"), F.count_if("json").alias("json"), F.count_if("header").alias("headers"), euler.alias("euler"))

    return run


for _m, _n in ((2, 3), (2, 4), (3, 3)):
    _k = COUNTS[_m, _n]["strong"][1]
    query(f"SELECT CAST({_k} AS BIGINT) AS classes, CAST({_k} AS BIGINT) AS compact, CAST({_k} AS BIGINT) AS json, CAST({_k} AS BIGINT) AS headers, CAST({_k - (_m == 2)} AS BIGINT) AS euler", f"codec_drawings_K{_m}_{_n}")(_round_trips(_m, _n))


# --- properties, flags and stages of drawings -------------------------------------------------------


@query("""SELECT * FROM (VALUES
('vertex-count', '4', '4'), ('path-count', '4', '4'), ('crossing-count', '0', '1'), ('path-crossing-counts', '[0, 0, 0, 0]', '[0, 0, 1, 1]'), ('path-lengths', '[2, 2, 2, 2]', '[2, 2, 3, 3]'),
('max-path-length', '2', '3'), ('min-path-crossing-count', '0', '0'), ('min-multiplicity-path-crossing-count', '4', '2'), ('distinct-count-path-length', '1', '2'),
('vertex-incident-path-crossing-counts', '[(2, (0, 0)), (2, (0, 0)), (2, (0, 0)), (2, (0, 0))]', '[(2, (0, 1)), (2, (0, 1)), (2, (0, 1)), (2, (0, 1))]'), ('crossing-endpoint-degrees', '[]', '[(2, 2, 2, 2)]')
) t(property, planar, crossed)""")
def bucket_properties_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket properties of the two drawings of the 4-cycle."""
    c = census.census_of(2, 2)
    names = ("vertex-count", "path-count", "crossing-count", "path-crossing-counts", "path-lengths", "max-path-length", "min-path-crossing-count", "min-multiplicity-path-crossing-count", "distinct-count-path-length", "vertex-incident-path-crossing-counts", "crossing-endpoint-degrees")
    planar, crossed = sorted(seeds(c), key=lambda d: len(d.crossings(4)))
    rows = [(x, *(str(canonical.invariant(d, x, c.points)) for d in (planar, crossed))) for x in names]
    return spark.createDataFrame(rows, "property string, planar string, crossed string")


@query("SELECT CAST(27 AS BIGINT) AS fixed_by_side_swap, true AS candidates_cover, CAST(27 AS BIGINT) AS fixed_candidates")
def side_swap_candidates_K3_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class that the side swap fixes is a candidate for it."""
    sets = _sets(spark, 3, 3)
    x = census.strong_classes(sets, 3, 3).select("fixed_by_side_swap", (F.col("side_swap_candidates") >= F.col("fixed_by_side_swap")).alias("candidates_cover"))
    return x.join(sets.agg(F.count_if(F.col("swap_fixed") & F.col("swap_candidate")).alias("fixed_candidates")))


@query("SELECT CAST(6 AS BIGINT) AS classes, CAST(6 AS BIGINT) AS buckets_hold, CAST(24 AS BIGINT) AS relabelings")
def bucket_hash_K2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket hashes of all classes under all relabelings of the graph: one for each class's drawings."""
    c = census.census_of(2, 3)
    moves = [c.points.relabeling(dict(enumerate(p))) for p in c.group]

    def make(form: bytes) -> tuple:
        d = canonical.unpack(form)
        hashes = {canonical.bucket_hash(relabel(d, c.points, move), c.points) for move in moves}
        return len(hashes) == 1, 2 * len(moves)

    return _mapped(census.classes(spark, 2, 3).select("form"), "same boolean, moves long", make).agg(F.count("*").alias("classes"), F.count_if("same").alias("buckets_hold"), F.max("moves").alias("relabelings"))


@query("""SELECT flag, substr(sha256(kept), 1, 2) AS bucket, substr(sha256(blind), 1, 2) AS blind_bucket, invariant FROM (VALUES
('4 0 1 1 2 2 0', '0|1:0,0;2:0,0', '0|0,0;0,0', '4 0 1 1 2 2 0'), ('4 0 1 1 2 2 1 1324', '1|1:1,1;2:1,1', '1|1,1;1,1', '4 0 1 1 2 2 1')) t(flag, kept, blind, invariant)""")
def flag_buckets_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = census.census_of(2, 2)
    rows = flags.labeled(flags.exported(census.crossing_sets(census.seed_classes(spark, 2, 2), 2, 2), c)).where("kind = 'crossing'")
    flag = F.col("flag")
    return rows.select("flag", flags.flag_bucket(flag, False).alias("bucket"), flags.flag_bucket(flag, True).alias("blind_bucket"), flags.simple_invariant(flag).alias("invariant"))


def _bucketed(m: int, n: int, kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Flag classes counted bucket by bucket: no class lies in two buckets."""
        c = census.census_of(m, n)
        rows = written(flags.labeled(flags.exported(_sets(spark, m, n), c)).withColumn("bucket", flags.flag_bucket(F.col("flag"), False)), "flags")
        names, moves = flags.token_moves(c, kind, False)
        found = flags.flag_classes(rows, c, kind, False)
        ids = F.transform("tokens", lambda t: F.array_position(F.lit(names), t).cast("int"))
        canon = F.array_min(F.transform(F.lit(moves), lambda move: F.array_sort(F.transform(ids, lambda i: F.element_at(move, i)))))
        per = rows.where(F.col("kind") == kind).select("bucket", canon.alias("canon")).distinct()
        return found.agg(F.count("*").alias("classes")).join(per.agg(F.count("*").alias("in_buckets")))

    return run


for _m, _n in ((2, 4), (3, 3)):
    for _kind in flags.KINDS:
        _k = COUNTS[_m, _n][_kind][0]
        query(f"SELECT CAST({_k} AS BIGINT) AS classes, CAST({_k} AS BIGINT) AS in_buckets", f"flag_buckets_{_kind}_K{_m}_{_n}")(_bucketed(_m, _n, _kind))


def _streamed(m: int, n: int, kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = census.census_of(m, n)
        parents = census.classes(spark, m, n, stages=len(c.stages) - 1)
        rows = flags.labeled(flags.exported(census.final_crossing_sets(spark, parents, m, n), c))
        return flags.flag_class_counts(rows, c, kind)

    return run


for _m, _n in ((2, 4), (3, 3)):
    for _kind in flags.KINDS:
        _kept, _blind = COUNTS[_m, _n][_kind]
        query(f"SELECT CAST({_kept} AS BIGINT) AS color_preserving, CAST({_blind} AS BIGINT) AS color_blind", f"streamed_{_kind}_flags_K{_m}_{_n}")(_streamed(_m, _n, _kind))


@query("SELECT * FROM (VALUES (0, 6), (1, 40)) t(stage, classes)")
def stage_classes_K2_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes after each stage: those of K(2,3), then of K(2,4)."""
    rows = (census.classes(spark, 2, 4, stages=k + 1).agg(F.lit(k).alias("stage"), F.count("*").cast("int").alias("classes")) for k in range(2))
    return reduce(DataFrame.unionByName, rows)


@query("SELECT 0 AS step, true AS parents_carry, true AS routes_cover, true AS distinct_within UNION ALL SELECT 1, true, true, true")
def profile_steps_K2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of the first stage did: parents, routes, drawings and distinct ones fit together."""
    x = profile.step_totals(profile.profile_stage(census.seed_classes(spark, 2, 3), 2, 3, 0))
    before = x.select((F.col("step") + 1).alias("step"), F.col("distinct").alias("carried"))
    x = x.join(before, "step", "left").where("step < 2")
    return x.select("step", (F.col("parents") == F.coalesce("carried", F.lit(2))).alias("parents_carry"), (F.col("routes") - F.col("infeasible") <= F.col("drawings")).alias("routes_cover"), (F.col("distinct") <= F.col("drawings")).alias("distinct_within"))


@query("""WITH g AS (SELECT m.range AS m, n.range AS n FROM range(2, 5) m JOIN range(2, 7) n ON m.range <= n.range AND m.range + n.range <= 8)
SELECT m, n, m + n AS vertices, m * n AS edges, m + n - 4 AS stages, CAST(m * (m - 1) // 2 * (n * (n - 1) // 2) * 2 AS BIGINT) AS crossings, true AS connected, true AS base_is_cycle, true AS colored FROM g""")
def kmn_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of each graph: sizes, stages, base cycle; connectivity and colors are checked on the way."""
    rows = []
    for m, n in COUNTS:
        c = census.census_of(m, n)
        graph.require_connected(c.points.vertices, c.points.edges)
        cycle = [tuple(sorted(e)) for e in zip(c.cycle, (*c.cycle[1:], c.cycle[0]))]
        inside = {tuple(sorted(e)) for e in c.points.edges}
        rows.append((m, n, len(c.points.vertices), len(c.points.edges), len(c.stages), len(c.points.parts), True, len(cycle) == 4 and set(cycle) <= inside, flags.checked_colors(c.colors, m, n) == c.colors))
    return spark.createDataFrame(rows, "m long, n long, vertices long, edges long, stages long, crossings long, connected boolean, base_is_cycle boolean, colored boolean")


# --- a run's events, made of the given ones ---------------------------------------------------------


def _run_events(x: DataFrame) -> DataFrame:
    """The given events as those of a run: timestamp, event_type, payload_json."""
    step = lambda k: F.struct((F.col("event_id") % 3 + k).alias("routes"), (F.col("event_id") % 5).alias("drawings"), (F.col("event_id") % 2).alias("infeasible"), F.lit(0.5).alias("seconds"))
    block = F.struct(F.lit(2.0).alias("total_seconds"), F.array(step(0), step(1)).alias("steps"))
    used = F.struct(F.lit(0.25).alias("worker_cpu_seconds"), F.col("event_id").alias("worker_max_rss_kib"), block.alias("block"))
    payload = F.struct((F.col("user_id") % 4).alias("stage_index"), (F.col("event_id") % 100).alias("candidates_seen"), (F.col("event_id") % 7).alias("candidates_submitted"), F.lit(1.5).alias("elapsed_seconds"), F.concat(F.lit("w"), F.col("user_id") % 6).alias("worker_id"), used.alias("profile"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return x.select(seconds.alias("timestamp"), "event_type", F.to_json(payload).alias("payload_json"))


_STAGES = """SELECT event_type, CAST(user_id % 4 AS INTEGER) AS stage_index, count(*) AS tasks, CAST(sum(event_id % 100) AS BIGINT) AS seen, CAST(sum(event_id % 7) AS BIGINT) AS submitted, count(*) * 0.25::DOUBLE AS cpu_seconds,
max(event_id) AS max_rss_kib, round(max(epoch(ts)) - min(epoch(ts)) + 1.5, 3) AS span_seconds, count(*) * 2.0::DOUBLE AS block_seconds FROM events GROUP BY event_type, user_id % 4"""


@query(_STAGES)
def run_stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.stage_summary(_run_events(table(spark, sf_dir, "events"))).withColumn("span_seconds", F.round("span_seconds", 3))


@query(f"SELECT event_type, stage_index, round(seen / span_seconds, 6) AS seen_per_second, round(submitted / seen, 6) AS submitted_share FROM ({_STAGES.replace('round(max(epoch(ts)) - min(epoch(ts)) + 1.5, 3)', 'max(epoch(ts)) - min(epoch(ts)) + 1.5')})")
def run_stage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = diagnostics.stage_rates(_run_events(table(spark, sf_dir, "events")))
    return x.select("event_type", "stage_index", F.round("seen_per_second", 6).alias("seen_per_second"), F.round("submitted_share", 6).alias("submitted_share"))


@query("""SELECT CAST(user_id % 4 AS INTEGER) AS stage_index, CAST(k.range AS INTEGER) AS step, count(*) * 0.5::DOUBLE AS seconds, CAST(sum(event_id % 3 + k.range) AS BIGINT) AS routes,
CAST(sum(event_id % 5) AS BIGINT) AS drawings, CAST(sum(event_id % 2) AS BIGINT) AS infeasible FROM events JOIN range(0, 2) k ON true GROUP BY user_id % 4, k.range""")
def run_step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.step_summary(_run_events(table(spark, sf_dir, "events")))


@query("SELECT concat('w', user_id % 6) AS worker, round(max(epoch(ts)), 3) AS last_seen FROM events GROUP BY user_id % 6 HAVING max(epoch(ts)) >= (SELECT max(epoch(ts)) FROM events) - 3600")
def run_active_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _run_events(table(spark, sf_dir, "events"))
    now = x.agg(F.max("timestamp").alias("now"))
    return diagnostics.active_workers(x, F.get_json_object("payload_json", "$.worker_id"), now, 3600.0).withColumn("last_seen", F.round("last_seen", 3))


_LEASES = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'leased' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status, o_custkey AS owner, o_totalprice AS lease_until FROM orders"


def _leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "leased").when(F.col("o_orderstatus") == "F", "done").otherwise("pending")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("lease_until"))


@query(f"SELECT o_orderkey FROM ({_LEASES}) WHERE status = 'leased' AND lease_until < 150000")
def run_expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.expired(_leases(spark, sf_dir), 150000.0).select("o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN e THEN 'pending' ELSE status END AS status, CASE WHEN NOT e THEN owner END AS owner, CASE WHEN NOT e THEN lease_until END AS lease_until FROM (SELECT *, status = 'leased' AND lease_until < 150000 AS e FROM ({_LEASES}))")
def run_requeued_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases that have passed, given back in the stored table; only the partitions that hold such ones are rewritten."""
    path, none = new_folder(spark, "leases"), F.lit(None)
    stored.insert_new(_leases(spark, sf_dir), path, ["o_orderkey"], 0)
    passed = (F.col("status") == "leased") & (F.col("lease_until") < 150000.0)
    stored.update(spark, path, passed, {"status": F.lit("pending"), "owner": none.cast("long"), "lease_until": none.cast("double")}, 1)
    return stored.read(spark, path)


@query("SELECT l_returnflag AS operation, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, max(CAST(l_quantity AS BIGINT)) AS longest FROM lineitem GROUP BY 1 ORDER BY total DESC, operation LIMIT 2")
def run_operation_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("operation"), F.col("l_quantity").cast("long").alias("seconds"))
    return diagnostics.operation_timings(x, 2)


@query("SELECT event_type, round(sum(length(props)) / 1e6, 6) AS mb, round(max(epoch(ts)) + 1 - min(epoch(ts)), 3) AS seconds, round(sum(length(props)) / 1e6 / (max(epoch(ts)) + 1 - min(epoch(ts))), 12) AS mb_per_second FROM events GROUP BY event_type")
def run_throughput_mb(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    x = table(spark, sf_dir, "events").select("event_type", F.length("props").alias("size"), at.alias("begin"), (at + 1).alias("end"))
    out = diagnostics.throughput_mb(x, "size", "begin", "end", "event_type")
    return out.select("event_type", F.round("mb", 6).alias("mb"), F.round("seconds", 3).alias("seconds"), F.round("mb_per_second", 12).alias("mb_per_second"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events as a stream."""
    schema = table(spark, sf_dir, "events").schema
    x = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _run_events(x).withColumn("ts", F.timestamp_seconds("timestamp"))


def _drained(spark: SparkSession, df: DataFrame, mode: str = "complete") -> DataFrame:
    return streams.drain(df, mode)


@query("SELECT event_type, CAST(user_id % 4 AS INTEGER) AS stage_index, count(*) AS tasks, CAST(sum(event_id % 100) AS BIGINT) AS seen, CAST(sum(event_id % 7) AS BIGINT) AS submitted FROM events GROUP BY event_type, user_id % 4")
def stream_stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, streams.stage_progress(_stream(spark, sf_dir)))


@query("SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS seen FROM events GROUP BY 1, 2")
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _drained(spark, streams.throughput(_stream(spark, sf_dir), "1 day"))
    return x.select("event_type", F.floor(F.unix_seconds("window.start") / 86400).alias("day"), "n", "seen")


@query("SELECT DISTINCT concat(event_type, event_id) AS flag FROM events")
def stream_distinct_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select(F.concat("event_type", F.get_json_object("payload_json", "$.profile.worker_max_rss_kib")).alias("flag"), "ts")
    return _drained(spark, streams.distinct_flags(rows), "append").select("flag").distinct()
