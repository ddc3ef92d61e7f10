import json

import pytest
from pyspark.sql import functions as F

from planarflow import cli
from planarflow.operators import census, flags
from planarflow.plans.golden import COUNTS, verdicts
from planarflow.plans.run import Run


@pytest.mark.parametrize("m,n", [(2, 2), (2, 3), (2, 4), (3, 3), (2, 5)])
def test_published_numbers(spark, m, n):
    c = census.census_of(m, n)
    sets = census.crossing_sets(census.classes(spark, m, n), m, n).cache()
    got = census.strong_classes(sets, m, n).first()
    assert (got.color_preserving, got.color_blind) == COUNTS[m, n]["strong"]
    rows = flags.labeled(flags.exported(sets, c)).cache()
    for kind in flags.KINDS:
        assert tuple(flags.flag_class_counts(rows, c, kind).first()) == COUNTS[m, n][kind]
    assert got.fixed_by_side_swap == {(2, 2): 2, (3, 3): 27}.get((m, n))


def test_last_stage_without_drawings(spark):
    parents = census.reduce_classes(census.expand(census.seed_classes(spark, 3, 3), 3, 3, 0)).cache()
    c = census.census_of(3, 3)
    full = census.crossing_sets(census.expand(parents, 3, 3, 1), 3, 3)
    short = census.final_crossing_sets(spark, parents, 3, 3)
    for kind in flags.KINDS:  # expansion keeps one labeling of each form, so classes are compared
        a, b = ({tuple(r.canon) for r in flags.flag_classes(flags.labeled(flags.exported(x, c)), c, kind, True).collect()} for x in (full, short))
        assert a == b and len(a) == COUNTS[3, 3][kind][1]


def test_run_resumes_and_checks(spark, tmp_path):
    out = str(tmp_path / "run")
    first = Run(spark, out, 2, 3).run()
    assert first["exported_rows"] == {"crossing": 6, "four": 6} and {v[0] for v in first["checks"]} == {"PASS"}
    assert Run(spark, out, 2, 3).run() == first
    assert "| strong | 6 | 6 |" in (tmp_path / "run" / "report.md").read_text()
    with pytest.raises(ValueError):
        Run(spark, out, 2, 4)
    with pytest.raises(ValueError):
        Run(spark, out, 3, 6)
    assert cli.main(["check", str(tmp_path / "run" / "summary.json")]) == 0
    wrong = json.loads((tmp_path / "run" / "summary.json").read_text()) | {"four": {"color_preserving": 1, "color_blind": 1}}
    (tmp_path / "wrong.json").write_text(json.dumps(wrong))
    assert cli.main(["check", str(tmp_path / "wrong.json")]) == 1
    assert ("SKIP", "four", None, (4, 4)) in verdicts({"m": 2, "n": 3})


def test_failures_are_recorded(spark, tmp_path):
    run = Run(spark, str(tmp_path / "r"), 2, 3)
    with pytest.raises(ZeroDivisionError):
        run.part("bad", lambda: 1 // 0)
    assert json.loads((tmp_path / "r" / "run.json").read_text())["parts"]["bad"]["status"] == "failed"
    assert run.part("bad", lambda: {"x": 1}) == {"x": 1} == run.part("bad", lambda: 1 // 0)


def test_flag_buckets(spark):
    rows = [("6 0 1 1 1 2 2 2 2 1423 1526",), ("6 0 1 1 1 2 2 2 2 2513 2614",), ("6 0 2 2 2 1 1 1 2 1423 1526",)]
    df = spark.createDataFrame(rows, "flag string")
    kept = [r[0] for r in df.select(flags.flag_bucket(F.col("flag"), False)).collect()]
    blind = [r[0] for r in df.select(flags.flag_bucket(F.col("flag"), True)).collect()]
    assert kept[0] == kept[1] and blind[0] == blind[2] and all(len(x) == 2 for x in kept + blind)
    assert df.select(flags.simple_invariant(F.col("flag"))).first()[0] == "6 0 1 1 1 2 2 2 2"


def test_labels(spark):
    points = census.census_of(2, 2).points
    rows = {r.crossing: (r.point, r.four) for r in flags.label_table(spark, points).collect()}
    assert rows == {"1324": (points.crossing_id[((3, 1), (2, 0))], "1234"), "1423": (points.crossing_id[((3, 0), (2, 1))], "1234")}
    assert flags.token(points, points.crossing_id[((3, 1), (2, 0))], "crossing") == "1324"
    with pytest.raises(ValueError):
        flags.label(9, 1)


def test_stages_are_deleted_when_read(spark, tmp_path):
    run = Run(spark, str(tmp_path / "r"), 2, 4)
    first = run.run(keep_stages=False)
    left = [p.name for p in (tmp_path / "r" / "classes" / "K_2_4").iterdir()]
    assert left == ["stage=1"] and [s["classes"] for s in first["stages"]] == [6, 40]
    assert Run(spark, str(tmp_path / "r"), 2, 4).run() == first
    text = (tmp_path / "r" / "report.md").read_text()
    assert "| classes |" in text and len((tmp_path / "r" / "log.jsonl").read_text().splitlines()) == 2
    assert run.record["parts"]["classes"]["driver"]["max_rss_kib"] > 0


def test_small_helpers(tmp_path):
    from planarflow.plans.run import git_revision, time_report

    assert time_report("\tMaximum resident set size (kbytes): 12\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 0:01.5\nno colon") == {"Maximum resident set size (kbytes)": "12", "Elapsed (wall clock) time (h:mm:ss or m:ss)": "0:01.5"}
    assert git_revision(str(tmp_path)) == "unknown"
    assert flags.checked_colors((1, 1, 2, 2, 2), 2, 3) == (1, 1, 2, 2, 2) == flags.checked_colors([1, 1, 2, 2, 2], 3, 2)
    for wrong in ((1, 2, 2, 2, 2), (1, 1, 2, 2), (1, 1, 3, 3, 3)):
        with pytest.raises(ValueError):
            flags.checked_colors(wrong, 2, 3)
