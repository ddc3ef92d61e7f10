"""A pipeline over documents: toxic ones go, one of each near-duplicate class stays, sources are mixed, texts become ids.

Nulls in any column, empty and very long texts take part in every stage: a null or empty text has no words, so it scores lowest,
is near nothing and has size 0 in the mix, of which it is part as often as its block is drawn; a null source is one of its own; a
null doc_id is a name like any other. Rows equal in doc_id and text are copies, of which one stays. Ties go to the least doc_id,
then to the least hash. Empty tables give empty results. Further columns, also under names that operators use, are kept until the
last stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarflow.llm import jaccard, mixing, pieces, toxicity
from planarflow.llm.common import cut, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the rejecting one."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, "_planarflow_score").where(F.col("_planarflow_score") < toxicity.REJECT).drop("_planarflow_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of similar ones; of rows with one doc_id and text, one.

    Rows are told by doc_id and text together. A row without a doc_id stays only if no row of its class has one."""
    keyed = docs.withColumn("_planarflow_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    with scratch() as keep:
        return _kept(keyed, docs.columns, keep)


def _kept(keyed: DataFrame, columns: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    classes = cut(jaccard.similar_documents(keyed.select(F.col("_planarflow_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_planarflow_key"), F.col("component_id").alias("_class")), "near-classes")
    rows = cut(classes.distinct().join(keyed.select("_planarflow_key", F.col("doc_id").alias("_id")).distinct(), "_planarflow_key"), "near-rows")
    best = rows.groupBy("_class").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_planarflow_key")).alias("b")).select("b._planarflow_key")
    gone = keep(cut(rows.join(best, "_planarflow_key", "left_anti").select("_planarflow_key"), "gone"))
    repeated = keep(cut(classes.groupBy("_planarflow_key").count().where("count > 1").select("_planarflow_key"), "repeated"))
    kept = keyed.join(gone, "_planarflow_key", "left_anti")
    if repeated.isEmpty():
        return kept.select(*columns)
    once = kept.join(repeated, "_planarflow_key", "left_semi").dropDuplicates(["_planarflow_key"]).select(*columns)
    return kept.join(repeated, "_planarflow_key", "left_anti").select(*columns).unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text that they decode to."""
    return pieces.encode_pieces(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("mixing", mix_sources), ("pieces", encode)]
#: SQL cannot express the trained classifier; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
