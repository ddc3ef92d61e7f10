"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, centroids, chat, exact_dedup, html_text, jaccard, mixing, near_vectors, pieces, sharding, token_files, toxicity
from .common import table


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings.
HARD_CHAT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    row = F.inline(F.array(*(F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in HARD_CHAT)))
    return chat.chat_digests(turns.unionByName(spark.range(1).select(row)))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_columns(table(spark, sf_dir, "documents"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digests(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_kd_shards, op2_mix_sources, op3_near_vectors, op4_sentencepiece, op5_chat_format, op6_jaccard_join, op7_html_text, op8_toxicity, op9_token_files, op10_media, op11_yinyang, op12_exact_dedup)
}

_ESCAPED = r"replace(replace(replace(coalesce(text, ''), '\', '\b'), '<', '\l'), '#', '\h')"
_ROLE = r"replace(replace(replace(replace(replace(coalesce(role, ''), '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c'), chr(10), '\n')"

_REACH = """
reach(a, b) AS (SELECT id, id FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


def _lloyd(rounds: int) -> str:
    """Plain rounds of assignment to the nearest centroid and exact means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, min({{'d': list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), 'k': k}}) AS m FROM vec, c{i} GROUP BY r),
s{i} AS (SELECT m.k AS k, p.range AS p, floor(sum(v[p.range]) / count(*)) AS x FROM a{i} JOIN vec USING (r), range(1, 65) p GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT k, list(x ORDER BY p) AS c FROM s{i} GROUP BY k) n USING (k))""")
    return ",".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op11_yinyang": f"""
WITH vec AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), v) - 1 AS k, v AS c FROM vec ORDER BY k LIMIT 40), {_lloyd(5)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a5 JOIN vec USING (r) JOIN c5 ON m.k = c5.k
""",
    "op12_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY chars DESC, doc_id NULLS LAST)
""",
    "op3_near_vectors": f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.v, q.v) >= 0.9
), node AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM link WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM least
""",
    "op6_jaccard_join": f"""
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM word
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM shingle p JOIN shingle q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
node AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN size ON size.doc_id = id
""",
    "op5_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), loss AS (
  SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY conv_id
), step AS (
  SELECT conv_id, coalesce(role, '') AS role, row_number() OVER w - 1 AS k, coalesce(lag(coalesce(role, '')) OVER w, 'start') AS before FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
), bad AS (
  SELECT conv_id, min(k) FILTER (before || ' ' || role NOT IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user')) AS bad_turn FROM step GROUP BY conv_id
)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))) AS turns_sha256,
  length(any_value(loss)) AS loss_chars, sha256(any_value(loss)) AS loss_sha256,
  CAST(sum(length('### ' || {_ROLE} || ': ' || {_ESCAPED} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  any_value(bad_turn) IS NULL AS valid, CAST(any_value(bad_turn) AS INTEGER) AS bad_turn
FROM t JOIN loss ON t.conv_id IS NOT DISTINCT FROM loss.conv_id JOIN bad ON t.conv_id IS NOT DISTINCT FROM bad.conv_id GROUP BY t.conv_id
""",
}
