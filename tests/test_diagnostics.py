import json

from pyspark.sql import functions as F

from planarflow.operators import diagnostics as d
from planarflow.streaming import events as stream


def payload(elapsed, seen, submitted, cpu, rss, total, steps):
    block = {"kind": "vertex", "vertex": 4, "total_seconds": total, "steps": [{"edge": [4, 0], "seconds": s, "routes": r, "drawings": w, "infeasible": i} for s, r, w, i in steps]}
    return json.dumps({"stage_index": 1, "candidates_seen": seen, "candidates_submitted": submitted, "elapsed_seconds": elapsed, "worker_id": "w", "profile": {"worker_cpu_seconds": cpu, "worker_max_rss_kib": rss, "block": block}})


ROWS = [(10.0, "job_result", payload(4.0, 10, 7, 2.0, 100, 2.0, [(2.0, 8, 6, 2)])), (12.0, "job_result", payload(3.0, 12, 8, 4.0, 120, 3.0, [(3.0, 12, 9, 3)])), (13.0, "note", "{not json"), (14.0, "note", None)]


def test_stage_summary(spark):
    df = spark.createDataFrame(ROWS, d.EVENT)
    (r,) = d.stage_summary(df).collect()
    assert (r.tasks, r.seen, r.submitted, r.cpu_seconds, r.max_rss_kib, r.span_seconds, r.block_seconds) == (2, 22, 15, 6.0, 120, 6.0, 5.0)
    (s,) = d.step_summary(df).collect()
    assert (s.seconds, s.routes, s.drawings, s.infeasible) == (5.0, 20, 15, 5)


def test_upserts_and_counts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "w"), ("b", 1, None)], "k string, at int, v string")
    assert {r.k: r.v for r in d.latest(df, "k", "at").collect()} == {"a": "w", "b": None}
    assert {r.k: r.v for r in d.first_wins(df, "k", "at").collect()} == {"a": "x", "b": None}
    assert {r.k: r.v for r in d.least_payload(df, ["k"], "v").collect()} == {"a": "w", "b": None}
    owners = spark.createDataFrame([("a",), ("c",)], "k string")
    got = {r.k: r.late for r in d.with_counts(owners, "k", df, "k", late=F.col("at") > 1).collect()}
    assert got == {"a": 1, "c": 0}
    assert [r.k for r in d.without(owners, "k", df, "k").collect()] == ["c"] and [r.k for r in d.having(owners, "k", df, "k").collect()] == ["a"]


def test_ratio_and_leases(spark):
    df = spark.createDataFrame([(1, 2), (1, 0)], "a int, b int")
    assert [r[0] for r in df.select(d.ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None]
    leases = spark.createDataFrame([("x", "leased", 5.0), ("y", "leased", 50.0), ("z", "done", 5.0)], "job string, status string, lease_until double")
    assert [r.job for r in d.expired(leases, 10.0).collect()] == ["x"]
    times = spark.createDataFrame([("r", 1.0), ("r", 3.0), ("s", 2.0)], "operation string, seconds double")
    assert [tuple(r) for r in d.operation_timings(times, 1).collect()] == [("r", 2, 4.0, 3.0)]


def test_streams(spark, tmp_path):
    (tmp_path / "e.json").write_text("".join(json.dumps({"timestamp": t, "event_type": e, "payload_json": p}) + "\n" for t, e, p in ROWS))
    events = stream.read_events(spark, str(tmp_path))
    (r,) = stream.drain(stream.stage_progress(events)).collect()
    assert (r.tasks, r.seen, r.submitted) == (2, 22, 15)
    assert {x.event_type: x.n for x in stream.drain(stream.throughput(stream.read_events(spark, str(tmp_path)))).collect()} == {"job_result": 2, "note": 2}
    assert stream.drain(stream.sessions(stream.read_events(spark, str(tmp_path)))).count() == 2
    flags = stream.read_events(spark, str(tmp_path)).withColumn("flag", F.col("event_type"))
    assert stream.drain(stream.distinct_flags(flags), "append").count() == 2
