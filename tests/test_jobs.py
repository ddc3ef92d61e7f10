import json
import os
import shutil
import subprocess
import sys
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from jobs import run_status, unique_lines

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EVENTS = json.load(open(f"{HERE}/jobs/run_status.json"))["schema"]
START = datetime(2024, 3, 1, 22, 30)


def events(first, count, users=5):
    """Events with gaps around the lease, nulls, and equal times."""
    out = []
    for i in range(first, first + count):
        at = START + timedelta(seconds=i * 97 + (i % 7) * 61)
        out.append((i, None if i % 53 == 0 else at, i % users, None if i % 17 == 0 else f"t{i % 3}", None if i % 19 == 0 else i / 4, None if i % 13 == 0 else "no json" if i % 29 == 0 else json.dumps({"k": i % 100})))
    return out


def expected(rows, lease=300):
    once = {r for r in rows if r[1] is not None}
    held, users, silent = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in once:
        for kind in (r[3] or "unknown", None):
            held[kind, r[1].date()].append(r)
        users[r[1].date(), r[2]].append(r[1])
    for (day, _), times in users.items():
        times.sort()
        silent[day] += sum((b - a).total_seconds() > lease for a, b in zip(times, times[1:]))
    out = []
    for (kind, day), mine in held.items():
        counts = [json.loads(r[5])["k"] if r[5] and r[5][0] == "{" else None for r in mine]
        values = [r[4] for r in mine if r[4] is not None]
        seconds = [r[1].hour * 3600 + r[1].minute * 60 + r[1].second for r in mine]
        out.append((kind, len(mine), len({r[2] for r in mine}), sum(values) if values else None, max(values, default=None), sum(c or 0 for c in counts), counts.count(None), min(seconds), max(seconds), None if kind else silent[day], day))
    return sorted(out, key=str)


def put(spark, rows, folder, name):
    """One file more in the folder of the log."""
    beside = f"{folder}-{name}"
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(beside)
    (part,) = [f for f in os.listdir(beside) if f.startswith("part-")]
    os.makedirs(folder, exist_ok=True)
    shutil.move(f"{beside}/{part}", f"{folder}/{name}.parquet")


def found(spark, out):
    return sorted((tuple(r) for r in run_status.result(spark, out).collect()), key=str)


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


@pytest.fixture
def places(tmp_path):
    return tuple(str(tmp_path / n) for n in ("log", "out", "marks"))


def test_status_takes_in_what_is_new(spark, places):
    log, out, marks = places
    put(spark, events(0, 120), log, "a")
    assert run_status.run(spark, log, out, marks)["batches"] == 1
    assert found(spark, out) == expected(events(0, 120))
    before = files(out)
    assert run_status.run(spark, log, out, marks) == {"batches": 0, "days": 0}
    assert files(out) == before  # nothing new: nothing written
    # Later events, some delivered again, and late ones of the first day.
    late = [(9000 + i, START + timedelta(seconds=13 * i), 77, "late", 1.5, None) for i in range(9)]
    put(spark, events(100, 1500) + late, log, "b")
    run_status.run(spark, log, out, marks)
    assert found(spark, out) == expected(events(0, 1600) + late)
    assert spark.read.parquet(f"{out}/rejected").count() == sum(r[1] is None for r in [*events(0, 120), *events(100, 1500)])


def test_days_without_new_events_keep_their_files(spark, places):
    log, out, marks = places
    put(spark, events(0, 2000), log, "a")
    run_status.run(spark, log, out, marks)
    before = files(f"{out}/status")
    put(spark, [(1, datetime(2024, 5, 5, 1), 1, "t", 1.0, None)], log, "b")
    assert run_status.run(spark, log, out, marks)["days"] == 1
    after = files(f"{out}/status")
    assert len(after) > len(before) > 1 and all(after[f] == t for f, t in before.items())


def test_a_batch_that_failed_half_way_is_run_again(spark, places, monkeypatch):
    log, out, marks = places
    put(spark, events(0, 60), log, "a")
    run_status.run(spark, log, out, marks)
    put(spark, events(60, 60), log, "b")
    with monkeypatch.context() as m:
        m.setattr(run_status, "make_status", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run_status.run(spark, log, out, marks)
    assert run_status.run(spark, log, out, marks)["batches"] == 1
    assert found(spark, out) == expected(events(0, 120))


def test_a_lost_checkpoint_gives_the_same(spark, places, tmp_path):
    """All files come again, in other batches than before."""
    log, out, marks = places
    config = run_status.settings(None, "run_status.json")
    for i in range(3):
        put(spark, events(i * 50, 60), log, f"f{i}")
        run_status.run(spark, log, out, marks, config)
    assert run_status.run(spark, log, out, str(tmp_path / "new"), config | {"files_per_batch": 2})["batches"] == 2
    assert found(spark, out) == expected(events(0, 160))


def test_events_without_a_time_only(spark, places):
    log, out, marks = places
    put(spark, [(1, None, 1, "a", 1.0, None)] * 3, log, "a")
    assert run_status.run(spark, log, out, marks) == {"batches": 1, "days": 0}
    put(spark, events(0, 5), log, "b")
    run_status.run(spark, log, out, marks)
    assert found(spark, out) == expected(events(0, 5))


def test_files_batch_by_batch_give_the_same_as_at_once(spark, places, tmp_path):
    log, out, marks = places
    for i in range(3):
        put(spark, events(i * 80, 100), log, f"f{i}")
    config = run_status.settings(None, "run_status.json") | {"files_per_batch": 1}
    assert run_status.run(spark, log, out, marks, config)["batches"] == 3
    run_status.run(spark, log, str(tmp_path / "out2"), str(tmp_path / "marks2"))
    assert found(spark, out) == found(spark, str(tmp_path / "out2")) == expected(events(0, 260))


DOCS = [(1, "b\na\r\n\nb\n" + "x" * 5000), (2, None), (3, ""), (4, "a\n ß line \nA"), (None, "only here\na"), (5, "\r\n"), (1, "b")]


def lines(rows):
    held = defaultdict(list)
    for doc, text in rows:
        for line in (text or "").replace("\r\n", "\n").split("\n"):
            if line:
                held[line].append(doc)
    return {line: (len(d), min((x for x in d if x is not None), default=None)) for line, d in held.items()}


def test_lines_are_unique_sorted_and_numbered(spark, tmp_path):
    import hashlib

    source, out = str(tmp_path / "docs"), str(tmp_path / "out")
    rows = DOCS + [(100 + i, "\n".join(f"line {(i * j) % 50}" for j in range(20))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(source)
    want = lines(rows)
    first = unique_lines.run(spark, source, out)
    assert first["lines"] == sum(n for n, _ in want.values()) and first["records"] == len(want)
    got = sorted(map(tuple, unique_lines.result(spark, out).collect()), key=lambda r: r[1])
    order = sorted(want, key=lambda x: (hashlib.sha256(x.encode()).hexdigest()[:2], x.encode()))
    assert [r[3] for r in got] == order and [r[1] for r in got] == list(range(len(order)))
    assert {r[3]: r[4:6] for r in got} == want
    places = defaultdict(list)
    for r in got:
        places[r[0]].append(r)
    for bucket, mine in places.items():
        assert [r[2] for r in mine] == list(range(len(mine))) and {r[6] for r in mine} == {len(mine)}
        assert {r[7] for r in mine} == {sum(len(r[3].encode()) + 1 for r in mine)}
    assert unique_lines.run(spark, source, out) == first
    assert sorted(map(tuple, unique_lines.result(spark, out).collect()), key=lambda r: r[1]) == got


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    assert unique_lines.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"))["buckets"] == 0
    assert unique_lines.result(spark, str(tmp_path / "out")).count() == 0


def test_command_line(spark, places, tmp_path):
    log, out, marks = places
    put(spark, events(0, 30), log, "a")
    config = tmp_path / "mine.json"
    config.write_text('{"lease_seconds": 5}')
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.run_status", "--source", log, "--output", out, "--checkpoint", marks, "--config", str(config)], cwd=HERE, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
    assert "0 batches" in done.stderr
    assert found(spark, out) == expected(events(0, 30), 5)
