import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")  # Spark's state server speaks it

from planarflow.streaming import heartbeats  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, heartbeats.STORE)
    yield spark
    spark.conf.set(key, before)


def put(folder, name, beats):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps({"worker": w, "ts": (START + timedelta(seconds=s)).isoformat()}) + "\n" for w, s in beats)


def expected(beats, lease):
    out = []
    for w in {b[0] for b in beats}:
        times = sorted(s for x, s in beats if x == w)
        stretch = [times[0], times[0], 0]
        for t in times:
            if t - stretch[1] > lease:
                out.append((w, *stretch))
                stretch = [t, t, 0]
            stretch[1], stretch[2] = t, stretch[2] + 1
        out.append((w, *stretch))
    return sorted(out)


def run(spark, folder, out, marks):
    events = spark.readStream.schema("worker long, ts timestamp").option("maxFilesPerTrigger", 1).json(folder)
    q = heartbeats.stretches(events, 60, "5 minutes").writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
    q.awaitTermination()
    rows = spark.read.schema(heartbeats.STRETCH).parquet(out).collect()
    return sorted((r.worker, (r.began - START).total_seconds(), (r.ended - START).total_seconds(), r.beats) for r in rows)


def test_gaps_late_beats_and_a_restart(store, tmp_path):
    folder, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    r = random.Random(2)
    beats = sorted({(r.randrange(4), float(r.randrange(3000))) for _ in range(250)}, key=lambda b: b[1])
    late = [b for b in beats[122:140] if r.random() < 0.4]  # come with the next file, within the watermark
    first = [b for b in beats[:140] if b not in late]
    put(folder, "a", first)
    run(store, folder, out, marks)
    put(folder, "b", late + beats[140:])
    put(folder, "c", [(99, 9000.0)])  # moves the watermark past all others
    got = run(store, folder, out, marks)
    put(folder, "d", [(99, 20000.0)])
    got = run(store, folder, out, marks)
    assert got == [*expected(beats, 60), (99, 9000.0, 9000.0, 1)]
    assert run(store, folder, out, marks) == got
