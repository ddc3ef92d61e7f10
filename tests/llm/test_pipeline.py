import hashlib

import corpus_pipeline
from planarflow.llm import pieces, queries, toxicity
from planarflow.llm.common import table


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    (_, toxic), (_, alike), (_, mixed), (_, coded) = corpus_pipeline.STAGES

    clean = toxic(spark, docs, sf_dir)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels")).collect()}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == {d for d, p in scores.items() if not p}

    kept = alike(spark, clean, sf_dir)
    from tests.llm.test_jaccard import classes

    least = {c for _, _, c in classes([(r.doc_id, r.text) for r in clean.collect()])}
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == least

    mix = mixed(spark, kept, sf_dir)
    assert mix.columns == names and {r.doc_id for r in mix.collect()} <= least
    assert mix.groupBy("doc_id").count().where("count > 2").count() == 0

    out = {r.doc_id: r for r in coded(spark, mix, sf_dir).collect()}
    for r in mix.collect():
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_repeated_and_nameless_rows(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 2, 3, 4, 5, 6, 7]
    assert kept.where("doc_id IS NULL").count() == 1


def test_run_is_the_stages_in_turn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, docs.collect()))


def test_every_operator_has_its_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 13)]
    assert pieces.encode_pieces


def test_rows_are_told_by_doc_id_and_text(spark):
    one, other = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, one), (2, one + " x"), (2, other), (3, one + " y"), (3, one + " z"), (None, other + " n"), (None, "c d e f g h"), (None, "c d e f g h")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, one), (2, other), (None, "c d e f g h")], key=str)


def written(spark, folder, docs):
    labels = spark.createDataFrame([(0, 1, 1), (3, 0, 0), (None, None, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_awkward_documents_through_all_stages(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    long = spark.range(1).selectExpr("50L AS doc_id", "repeat('very long words ', 300000) AS text", "'en' AS lang", "CAST(NULL AS STRING) AS source")
    more = {c: F.lit("other") for c in set(docs.columns) - set(long.columns)}
    both = docs.unionByName(long.withColumns(more)).withColumn("_planarflow", F.lit(1)).withColumn("_draw", F.lit(2))
    folder = written(spark, tmp_path, both)
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in both.collect()}
    held = both
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, folder)
        assert held.columns == both.columns
    assert held.where("_draw = 2 AND size = 'other'").count() == held.count()


def test_no_documents(spark, no_docs, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, no_docs)).count() == 0
