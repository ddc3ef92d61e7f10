"""Queries that apply the engine's table operators to the given tables, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarflow.operators import digests, graphs, labelling, ordered, profile, stored, ties
from planarflow.sources import shards
from planarflow.sources.chunk_source import ChunkSource, file_facts
from planarflow.sources.folders import new_folder, written
from planarflow.sources.record_source import RecordSource
from planarflow.streaming import heartbeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- changes merged into stored tables --------------------------------------------------------------

#: Batches that the events come in, by day of the month.
BATCHES = 5


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    x = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return [x.where(F.floor((F.dayofmonth("ts") - 1) / 7) == b) for b in range(BATCHES)]


def _merged(spark: SparkSession, sf_dir: str, merge: Callable[[DataFrame, str, int], object]) -> str:
    """Every batch in turn, the third one twice; the path of the table."""
    path = new_folder(spark, "stored")
    batches = _batches(spark, sf_dir)
    for b in (0, 1, 2, 2, 3, 4):
        merge(batches[b], path, b)
    return path


@query("""SELECT user_id, event_id, event_type, cents FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY (day(ts) - 1) // 7, event_id) AS k FROM events) WHERE k = 1""")
def stored_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event, inserted batch after batch."""
    return stored.read(spark, _merged(spark, sf_dir, lambda x, path, b: stored.insert_new(x.select("user_id", "event_id", "event_type", "cents"), path, ["user_id"], b, ["event_id"])))


@query("""SELECT event_type, user_id, event_id, cents FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY event_type, user_id ORDER BY (day(ts) - 1) // 7 DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def stored_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event of each type; the table is partitioned by type."""
    return stored.read(spark, _merged(spark, sf_dir, lambda x, path, b: stored.replace(x.select("event_type", "user_id", "event_id", "cents"), path, ["event_type", "user_id"], b, ["event_id"], partition="event_type")))


@query("""SELECT user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, min(event_id) AS first_id, max(event_id) AS last_id, arg_max(event_type, (day(ts) - 1) // 7 * 1000000000 + event_id) AS last_type FROM events GROUP BY user_id""")
def stored_conflict_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each user; a batch that comes twice counts once."""
    rules = {"n": "sum", "cents": "sum", "first_id": "min", "last_id": "max", "last_type": "last"}

    def merge(x: DataFrame, path: str, b: int) -> None:
        # Sums are taken before the merge, so that a hot user's events meet in no task.
        own = x.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.max_by("event_type", "event_id").alias("last_type"))
        stored.combine(own, path, ["user_id"], rules, b)

    return stored.read(spark, _merged(spark, sf_dir, merge))


@query("""SELECT event_type, event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS cents FROM events
WHERE NOT (event_type = 'error' AND event_id % 2 = 0) OR (day(ts) - 1) // 7 >= 3 OR event_id % 10 = 4""")
def stored_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some are deleted after the third batch and some of these come back, and a column is emptied at the end."""
    batches, path, keys = [b.select("event_type", "event_id", "cents") for b in _batches(spark, sf_dir)], new_folder(spark, "stored"), ["event_type", "event_id"]
    add = lambda x, b: stored.insert_new(x, path, keys, b, partition="event_type")
    for b in range(3):
        add(batches[b], b)
        gone = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)
    stored.delete(spark, path, gone, 3)
    stored.compact(spark, path)
    add(batches[0].unionByName(batches[1]).unionByName(batches[2]).where("event_id % 10 = 4"), 4)
    for b in (3, 4):
        add(batches[b], b + 2)
    stored.update(spark, path, F.col("event_id") % 3 == 0, {"cents": F.lit(None).cast("long")}, 7)
    return stored.read(spark, path)


# --- sorted, numbered and bounded files -------------------------------------------------------------


@query("""SELECT l_suppkey, l_orderkey, n, most, row_number() OVER (ORDER BY l_suppkey, l_orderkey) - 1 AS row, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS records
FROM (SELECT l_suppkey, l_orderkey, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY ALL)""")
def sorted_unique_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders of each supplier in sorted files by supplier, numbered over all and within their supplier."""
    path = new_folder(spark, "sorted")
    ordered.sort_unique(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_orderkey"], path, "l_suppkey", {"most": F.max("l_quantity")})
    rows = spark.read.schema("l_orderkey long, n long, most double, _at long, l_suppkey long").parquet(path)
    return ordered.placed(rows, "l_suppkey").select("l_suppkey", "l_orderkey", "n", "most", "row", "place", "records")


#: Bytes of a shard of texts.
SHARD = 65_536


@query(f"""WITH u AS (SELECT text, octet_length(encode(text)) AS size FROM (SELECT DISTINCT text FROM documents)),
r AS (SELECT *, row_number() OVER (ORDER BY text) - 1 AS row, CASE WHEN size * 2 > {SHARD} THEN 0 ELSE size END AS small, size * 2 > {SHARD} AS big FROM u),
s AS (SELECT *, CAST(sum(small) OVER (ORDER BY row) - small AS BIGINT) AS before, count(*) FILTER (big) OVER (ORDER BY row) AS bigs FROM r),
d AS (SELECT *, CASE WHEN big THEN -bigs ELSE before // {SHARD - SHARD // 2} END AS shard FROM s)
SELECT sha256(text) AS text_sha256, row, CAST(shard AS BIGINT) AS shard, CAST(CASE WHEN big THEN 0 ELSE before - min(before) OVER (PARTITION BY shard) END AS BIGINT) AS "offset", CAST(sum(size) OVER (PARTITION BY shard) <= {SHARD} OR big AS BOOLEAN) AS fits FROM d""")
def size_bounded_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts in order, dealt to shards of bounded bytes, each with its offset there."""
    path, size = new_folder(spark, "shards"), F.octet_length("text")
    ordered.sort_unique(table(spark, sf_dir, "documents"), ["text"], path)
    dealt = ordered.deal_by_bytes(ordered.numbered(spark.read.schema("text string, n long, _at long").parquet(path)), size, SHARD)
    whole = dealt.groupBy("shard").agg((F.sum(size) <= SHARD).alias("_fits"))
    return dealt.join(whole, "shard").select(F.sha2("text", 256).alias("text_sha256"), "row", "shard", "offset", (F.col("_fits") | (F.col("shard") < 0)).alias("fits"))


# --- digests, ties, graphs ---------------------------------------------------------------------------


def _by_digest(digits: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Distinct texts by a digest of so many hex digits, with proof that those of one digest are equal."""
        found = digests.distinct_by_digest(table(spark, sf_dir, "documents"), "text", digests.short_digest("text", digits))
        return found.select("digest", F.sha2("payload", 256).alias("text_sha256"), "n", "collided")

    return run


for _digits in (2, 5, 16):
    QUERIES[f"digest_distinct_{4 * _digits}"] = _by_digest(_digits)
    ORACLE_SQL[f"digest_distinct_{4 * _digits}"] = f"SELECT substr(sha256(text), 1, {_digits}) AS digest, sha256(text) AS text_sha256, count(*) AS n, count(*) OVER (PARTITION BY substr(sha256(text), 1, {_digits})) > 1 AS collided FROM documents GROUP BY text"


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT *, coalesce(n, 0) AS m FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT c_nationkey, c_custkey, m AS n FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, m DESC, floor(c_acctbal / 2500) DESC) AS k FROM c) WHERE k = 1""")
def best_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's best customers, with ties: the first segment, of it most orders, of these the highest step of balance."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    x = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tiers = [(F.col("c_mktsegment"), "min"), (F.col("n"), "max"), (F.floor(F.col("c_acctbal") / 2500), "max")]
    return ties.best_rows(x, ["c_nationkey"], tiers).select("c_nationkey", "c_custkey", "n")


#: Rounds that the SQL is unrolled to: more than any distance in this graph.
STEPS = 7
_PURCHASE = "SELECT DISTINCT 2 * o_custkey AS c, 2 * l_partkey + 1 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_LABELS = ",".join(f"\nl{i + 1} AS MATERIALIZED (SELECT id, min(x) AS x FROM (SELECT * FROM l{i} UNION ALL SELECT e.u, x FROM e JOIN l{i} ON e.v = id) GROUP BY id)" for i in range(STEPS))
_DEPTHS = ",".join(f"\nd{i + 1} AS MATERIALIZED (SELECT id, min(depth) AS depth FROM (SELECT * FROM d{i} UNION ALL SELECT e.v, depth + 1 FROM e JOIN d{i} ON e.u = id) GROUP BY id)" for i in range(STEPS))


@query(f"""WITH g AS ({_PURCHASE}), e AS MATERIALIZED (SELECT c AS u, p AS v FROM g UNION ALL SELECT p, c FROM g), l0 AS (SELECT DISTINCT u AS id, u AS x FROM e), {_LABELS},
d0 AS (SELECT min(u) AS id, 0 AS depth FROM e), {_DEPTHS}
SELECT l{STEPS}.id AS vertex, x AS component, d.depth, (SELECT min(b.id) FROM e JOIN d{STEPS} b ON e.u = b.id WHERE e.v = d.id AND b.depth = d.depth - 1) AS parent FROM l{STEPS} LEFT JOIN d{STEPS} d USING (id)""")
def graph_frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts that purchases connect: components, and the order in which they are reached from the first customer."""
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey", (2 * F.col("l_partkey") + 1).alias("v"))
    edges = sold.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (2 * F.col("o_custkey")).alias("u")), "l_orderkey").select("u", "v")
    edges = written(graphs.undirected(edges), "sold")
    found = graphs.components(edges, simple=True)
    return found.join(graphs.distances(edges, found.agg(F.min("vertex").alias("vertex")), simple=True), "vertex", "left").select("vertex", "component", "depth", "parent")


@query("""WITH e AS MATERIALIZED (SELECT DISTINCT 2 * l_suppkey AS s, 2 * l_partkey + 1 AS p FROM lineitem), w AS (SELECT a.s AS x, b.s AS y, a.p FROM e a JOIN e b ON a.p = b.p AND a.s < b.s),
c AS (SELECT x, y, count(*) AS n FROM w GROUP BY ALL HAVING n > 1), v AS (SELECT p.p AS x, q.p AS y, count(*) AS n FROM e p JOIN e q ON p.s = q.s AND p.p < q.p GROUP BY ALL HAVING n > 1),
f AS (SELECT x, y FROM (SELECT x, y FROM c UNION ALL SELECT x, y FROM v) ORDER BY x, y LIMIT 1),
m AS (SELECT list_sort(list_intersect(i.near, j.near)) AS met FROM f JOIN (SELECT u, list(v) AS near FROM (SELECT s AS u, p AS v FROM e UNION ALL SELECT p, s FROM e) GROUP BY u) i ON i.u = x
JOIN (SELECT u, list(v) AS near FROM (SELECT s AS u, p AS v FROM e UNION ALL SELECT p, s FROM e) GROUP BY u) j ON j.u = y)
SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM c) AS cycles, x, y, met[1] AS a, met[2] AS b FROM f, m""")
def graph_four_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-cycles of suppliers and parts that were sold together, and the first of them."""
    return graphs.four_cycles(table(spark, sf_dir, "lineitem").select((2 * F.col("l_suppkey")).alias("u"), (2 * F.col("l_partkey") + 1).alias("v")))


# --- record files ------------------------------------------------------------------------------------


def _records(spark: SparkSession):
    spark.dataSource.register(RecordSource)
    return spark.read.format("records")


@query("SELECT coalesce(lang, 'none') AS lang, sha256(text) AS text_sha256, count(*) AS n FROM documents GROUP BY ALL")
def record_files_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as gzip record files in a folder of each language, and read from them."""
    reader, path = _records(spark), new_folder(spark, "records")
    rows = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("record"), F.coalesce("lang", F.lit("none")).alias("lang"))
    rows.sortWithinPartitions("lang").write.format("records").option("key", "lang").mode("append").save(path)
    return reader.option("key", "lang").load(path).groupBy("lang", F.sha2("record", 256).alias("text_sha256")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def record_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON records, a commit for each status; a stream reads the first commits, then a restarted one the others."""
    _records(spark)
    home = new_folder(spark, "record-stream")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    schema = "o_orderkey long, o_custkey long, o_orderstatus string"
    for statuses in (["F"], ["O"]), (["P", None],):
        for held in statuses:
            mine = F.col("o_orderstatus").isin([s for s in held if s]) | (F.col("o_orderstatus").isNull() if None in held else F.lit(False))
            orders.where(mine).select(F.to_json(F.struct("*")).cast("binary").alias("record")).write.format("records").mode("append").save(f"{home}/in")
        stream = spark.readStream.format("records").load(f"{home}/in").select(F.from_json(F.col("record").cast("string"), schema).alias("o")).select("o.*")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{home}/marks").trigger(availableNow=True).start(f"{home}/out").awaitTermination()
    return spark.read.schema(schema).parquet(f"{home}/out")


# --- shapes of small graphs, signs of life, measures taken on the way --------------------------------


def purchase_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders share parts in the same way: isomorphism classes of their graphs of orders and parts, with their sizes."""
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    edges = sold.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    edges = written(edges.select(F.col("o_custkey").alias("graph"), (2 * F.col("l_orderkey")).alias("u"), (2 * F.col("l_partkey") + 1).alias("v")), "sold")
    ends = edges.select("graph", F.explode(F.array(F.struct(F.col("u").alias("vertex"), F.lit("order").alias("colour")), F.struct(F.col("v").alias("vertex"), F.lit("part").alias("colour")))).alias("e")).select("graph", "e.*")
    found = labelling.graph_forms(ends, edges)
    return found.groupBy(F.sha2("form", 256).alias("shape")).agg(F.count("*").alias("customers"), F.min("graph").alias("first_customer"))


QUERIES["purchase_shapes"] = purchase_shapes  # no SQL: graph isomorphism; the tests hold it to brute force

#: Seconds without an event after which a user has fallen silent: longer than most of their gaps.
SILENT = 7_200


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, ts FROM events), g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {SILENT}000000, true) AS starts FROM e),
s AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g)
SELECT user_id AS worker, CAST(min(t) AS BIGINT) AS began, CAST(max(t) AS BIGINT) AS ended, count(*) AS beats FROM s GROUP BY user_id, k
HAVING max(t) + {SILENT}000000 < (SELECT max(t) // 1000 - 600000 FROM e) * 1000""")
def stream_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of life of each user that are over by the end of the stream, from state with timers."""
    key, home = "spark.sql.streaming.stateStore.providerClass", new_folder(spark, "stretches")
    before = spark.conf.get(key)
    spark.conf.set(key, heartbeats.STORE)
    try:
        schema = table(spark, sf_dir, "events").schema
        events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
        heartbeats.stretches(events, SILENT).writeStream.format("parquet").option("checkpointLocation", f"{home}/marks").trigger(availableNow=True).start(f"{home}/out").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(heartbeats.STRETCH).parquet(f"{home}/out").select("worker", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "beats")


@query("""WITH x AS (SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_suppkey, n, quantity, (SELECT count(*) FROM lineitem) AS rows_read, (SELECT count(*) FROM lineitem WHERE l_returnflag IS NULL) AS null_flags, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS rows_kept,
(SELECT count(*) FROM x) AS groups, (SELECT max(n) FROM x) AS largest FROM x""")
def measured_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate that is written once, with what its steps measured on the way."""
    path = new_folder(spark, "measured")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag")
    steps = profile.Measures()
    rows = steps.at(rows, "read", rows_read=F.count("*"), null_flags=F.count_if(F.col("l_returnflag").isNull()))
    kept = steps.at(rows.where("l_returnflag = 'R'"), "kept", rows_kept=F.count("*"))
    out = kept.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    steps.at(out, "grouped", groups=F.count("*"), largest=F.max("n")).write.parquet(path)
    return spark.read.schema(out.schema).parquet(path).select("*", *(F.lit(v).cast("long").alias(k) for k, v in steps.found().items()))


# --- shards and whole files --------------------------------------------------------------------------


def _shards(kind: str, columns: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Customers as records of one kind in shards by bucket, scanned again."""
        path = new_folder(spark, f"shards-{kind}")
        rows = table(spark, sf_dir, "customer").select(*(F.expr(e).alias(c) for c, e in columns.items()))
        shards.write_shards(rows, path, kind)
        found = shards.scan_shards(spark, path, kind).drop("file")
        return found.withColumn("payload", F.decode("payload", "utf-8")) if "payload" in columns else found

    return run


for _kind, _columns in (
    ("raw", {"bucket_hash": "sha2(c_mktsegment, 256)", "payload": "encode(c_name, 'utf-8')"}),
    ("reduced", {"report_hash": "sha2(c_name, 256)", "work_hash": "sha2(c_mktsegment, 256)", "payload": "encode(c_name, 'utf-8')"}),
    ("flag", {"flag_hash": "sha2(c_name, 256)", "invariant": "c_mktsegment", "flag": "c_name"}),
):
    QUERIES[f"shard_scan_{_kind}"] = _shards(_kind, _columns)
    _sql = {c: e.replace("sha2(", "sha256(").replace(", 256)", ")").replace("encode(c_name, 'utf-8')", "c_name") for c, e in _columns.items()}
    ORACLE_SQL[f"shard_scan_{_kind}"] = f"SELECT substr({next(iter(_sql.values()))}, 1, 2) AS prefix, {', '.join(f'{e} AS {c}' for c, e in _sql.items())} FROM customer"

#: Bytes of a chunk of the files that file_digests reads.
CHUNK = 4_096


@query(f"""WITH f AS (SELECT event_type, string_agg(event_id || ',' || user_id || chr(10), '' ORDER BY event_id) AS body FROM events GROUP BY 1),
c AS (SELECT event_type, body, list_transform(range(0, (length(body) + {CHUNK - 1}) // {CHUNK}), lambda i: sha256(substr(body, CAST(i * {CHUNK} + 1 AS BIGINT), {CHUNK}))) AS parts FROM f)
SELECT event_type, length(body) AS size, length(body) - length(replace(body, chr(10), '')) AS lines, CAST(len(parts) AS BIGINT) AS chunks, sha256(array_to_string(parts, '')) AS sha256 FROM c""")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file of each event type, digested in chunks, with its lines counted."""
    spark.dataSource.register(ChunkSource)
    path = new_folder(spark, "digested")
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.concat_ws(",", "event_id", "user_id").alias("value"))
    # One file per type, by its nature; the digest below has no need of that.
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    facts = file_facts(spark.read.format("chunks").option("chunkBytes", CHUNK).load(path))
    return facts.select(F.regexp_extract("file", "event_type=([^/]*)/", 1).alias("event_type"), "size", "lines", "chunks", "sha256")
