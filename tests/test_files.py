from pyspark.sql import functions as F

from planarflow.functions import canonical
from planarflow.operators import census, profile
from planarflow.plans.run import Run
from planarflow.sources import codec, files


def test_record_files_round_trip(spark, tmp_path):
    classes = census.classes(spark, 2, 3)
    packed = files.pack_record_files(files.compact_records(classes, 2, 3, 1).coalesce(1), 4).collect()
    assert sum(r.records for r in packed) == 6 and len(packed) == 2
    folder = tmp_path / "crossings-3"
    folder.mkdir()
    for r in packed:
        (folder / r.name).write_bytes(bytes(r.content))
    back = files.read_record_files(spark, str(tmp_path))
    assert {r.n for r in back.select(files.crossing_count_of(F.col("path")).alias("n")).collect()} == {3}
    forms = {bytes(r.form) for r in files.classes_of_records(back, 2, 3, 0).collect()}
    assert forms == {bytes(r.form) for r in classes.collect()}


def test_json_and_reduced_records(spark):
    classes = census.classes(spark, 2, 3)
    points = census.census_of(2, 3).points
    for r in files.json_drawings(classes, 2, 3).collect():
        assert codec.from_json(r.json, points) == canonical.unpack(bytes(r.form))
    for r in files.reduced_records(classes, 2, 3, 1).collect():
        one = codec.Reduced.decode(bytes(r.record))
        assert one.report_hash == one.work_hash and codec.header(one.payload) == (1, 1)


def test_profile_counts(spark):
    frontier = census.reduce_classes(census.expand(census.seed_classes(spark, 3, 3), 3, 3, 0))
    rows = {r.step: r for r in profile.step_totals(profile.profile_stage(frontier, 3, 3, 1)).collect()}
    assert rows[0].parents == 6 and rows[0].infeasible > 0 and rows[1].parents == rows[0].distinct
    assert all(r.routes - r.infeasible <= r.drawings for r in rows.values())


def test_flags_only_run(spark, tmp_path):
    run = Run(spark, str(tmp_path / "r"), 2, 3)
    full = run.classes() and run.export()
    assert full == {"crossing": 6, "four": 6}
    distinct = run.table("exported").where("kind = 'four'").select("flag").distinct().count()
    other = Run(spark, str(tmp_path / "s"), 2, 3).flags_only("four")["flags"]
    assert other >= distinct
    assert files.read_flags(spark, str(tmp_path / "r" / "exported-text")).count() == 12


def test_bucket_hash_is_invariant():
    c = census.census_of(3, 3)
    from planarflow.functions.drawing import extend_stage, relabel, seeds

    d = next(iter(extend_stage(c.points, seeds(c)[1], c.stages[0])))
    hashes = {canonical.bucket_hash(relabel(d, c.points, move), c.points) for move in c.stage_group(0)}
    assert len(hashes) == 1


def test_record_files_are_written_by_tasks(spark, tmp_path):
    classes = census.classes(spark, 2, 4)
    target = tmp_path / "out" / "crossings-1"
    written = files.write_record_files(files.compact_records(classes, 2, 4, 1).repartition(3), str(target), 7)
    again = files.write_record_files(files.compact_records(classes, 2, 4, 1).repartition(3), str(target), 7)
    assert written >= 6 and again >= 6 and not [f for f in target.iterdir() if f.name.startswith(".") and f.suffix != ".crc"]
    back = files.read_record_files(spark, str(tmp_path / "out"))
    assert files.classes_of_records(back, 2, 4, 1).count() == 40


def test_flags_only_run_has_the_classes_of_a_full_one(spark, tmp_path):
    full, short = Run(spark, str(tmp_path / "r"), 3, 3), Run(spark, str(tmp_path / "s"), 3, 3)
    full.classes(), full.export()
    from planarflow.operators import flags

    for kind in flags.KINDS:
        short.flags_only(kind)
        field = F.split("flag", " ")
        tokens = F.slice(field, 6 + 4, F.size(field))
        lines = files.read_flags(spark, str(tmp_path / "s" / f"flags-only-{kind}")).select(F.lit(kind).alias("kind"), "flag", tokens.alias("tokens"))
        a, b = ({tuple(r.canon) for r in flags.flag_classes(x, full.census, kind, True).collect()} for x in (flags.labeled(full.table("exported")), lines))
        assert a == b


def test_streamed_records_are_cut_off():
    import io

    import pytest

    out = bytearray()
    for r in (b"", b"x" * 300, b"ab"):
        codec.put_varint(len(r), out)
        out += r
    assert list(codec.stream_records(io.BytesIO(out))) == [b"", b"x" * 300, b"ab"] == list(codec.split_records(bytes(out)))
    for end in (len(out) - 1, 2):
        with pytest.raises(ValueError):
            list(codec.stream_records(io.BytesIO(out[:end])))
