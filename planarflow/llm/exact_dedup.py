"""Exact deduplication of texts with a heavy-hitter split, by DataFrame functions only.

Texts are equal when they are identical without white space. Each row's digest, its number of code points and a row number are
written once; the texts are not read again. A Misra-Gries summary of the digests, merged from one summary per task, names every
digest that more than `support` of all rows have, and some others. An exact pass over the rows of these verifies them: it gives
each one's number of rows and its winner, pre-aggregated before a shuffle of a few rows per task. The verified winners, 1 / support
at most, are broadcast: rows of frequent digests are decided where they stand and leave before the shuffle. The other digests are
grouped and joined in the ordinary way; a group of theirs has at most `support` of all rows, its minima are pre-aggregated, and the
join back can be split by adaptive execution.

Of equal texts the row with the most code points in the original text stays, then the one with the least doc_id, a null one last;
of rows equal in these, one. Null texts count as empty, and empty and white texts are equal to each other; texts of any length are
read whole. Repeated rows are copies of each other. An empty table gives an empty table. Further columns are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

#: Share of all rows beyond which a digest is frequent for certain; its inverse bounds the broadcast.
SUPPORT = 0.001
WHITE = " \t\n\x0b\x0c\r"


def bare(text: Column) -> Column:
    """The text without white space."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _identity(text: str) -> dict[str, Column]:
    return {"text_sha256": F.sha2(bare(F.col(text)), 256), "chars": F.char_length(F.coalesce(F.col(text), F.lit("")))}


def _winners(rows: DataFrame) -> DataFrame:
    """Digests of more than one row: number of rows, and the row that stays."""
    order = F.struct((-F.col("chars")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    out = rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    return out.where("group_size > 1").select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))


def copies(docs: DataFrame, text: str = "text", key: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256, chars; dropped rows too."""
    with scratch() as keep:
        rows = keep(cut(docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), *(c.alias(n) for n, c in _identity(text).items())), "digests"))
        candidates = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
        frequent = keep(cut(_winners(rows.join(F.broadcast(candidates), "text_sha256")), "frequent"))
        others = rows.join(F.broadcast(frequent), "text_sha256", "left_anti")
        repeated = keep(cut(_winners(others), "repeated"))
    at_once = rows.join(F.broadcast(frequent), "text_sha256")
    out = at_once.unionByName(others.join(repeated, "text_sha256", "left"))
    alone = F.col("keep_row").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256", "chars")


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, whole.

    Rows are found again by digest, code points and key; of rows equal in these, one stays."""
    names = {n: f"_planarflow_{n}" for n in ("text_sha256", "chars", "key")}
    decided = copies(docs, text, key, support).where("group_size > 1")
    found = decided.groupBy(*(F.col(c).alias(n) for c, n in zip(("text_sha256", "chars", "doc_id"), names.values()))).agg(F.max("kept").alias("stays"), F.count("*").alias("times"))
    with scratch() as keep:
        found = keep(cut(found.where("NOT stays OR times > 1"), "copies"))
    marked = docs.withColumns({names[n]: c for n, c in (_identity(text) | {"key": F.col(key)}).items()}).alias("d")
    same = lambda o: F.expr(" AND ".join(f"d.{n} <=> {o}.{n}" for n in names.values()))
    gone, once = found.where("NOT stays").alias("g"), found.where("stays").alias("o")
    left = marked.join(gone, same("g"), "left_anti")
    single = left.alias("d").join(once, same("o"), "left_anti")
    doubled = left.alias("d").join(once, same("o"), "left_semi").dropDuplicates(list(names.values()))
    return single.unionByName(doubled).select(*docs.columns)
