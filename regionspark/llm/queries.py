"""The operators' queries over the synthetic tables: each applies one operator to the whole of `documents`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, language_model, line_windows, merkle, mixing, near_dedup, packing, quality_net, quality_rules, secrets, toxicity, transport_stream


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", F.col("label").alias("class_label"))


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    stored = transport_stream.media_column(docs).select("doc_id", "n_bytes", "media")
    read = transport_stream.read_media(stored, ["doc_id", "n_bytes"])
    digest = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return read.select("doc_id", "n_bytes", *digest, "pts", "random_access")


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_windows.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept_text"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir), ["doc_id"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op12_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = debruijn.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"), counts=("n_words", "n_removed"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_near_dedup": op3_near_dedup,
    "op4_transport_stream": op4_transport_stream,
    "op5_line_windows": op5_line_windows,
    "op6_toxicity": op6_toxicity,
    "op7_quality_net": op7_quality_net,
    "op8_mixing": op8_mixing,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_debruijn_dedup": op12_debruijn_dedup,
}

_LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
), runs AS (
  SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS run
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth
  FROM runs WHERE run IS NOT NULL AND regexp_matches(run, '[^\x20\x09-\x0D]')
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
       coalesce(string_agg(CASE WHEN c.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS kept_text
FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i
GROUP BY l.doc_id
"""

_SUBSTRINGS_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM split
), runs AS (
  SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run FROM words
), ranked AS (
  SELECT doc_id, i, word,
         CASE WHEN i + 20 <= n AND row_number() OVER (PARTITION BY i + 20 <= n, run ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS later
  FROM runs
), marked AS (
  SELECT doc_id, i, word, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM ranked
)
SELECT d.doc_id, count(m.word) AS n_words, coalesce(sum(m.gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN m.gone = 0 THEN m.word END, ' ' ORDER BY m.i), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id
GROUP BY d.doc_id
"""



def _leaf_sql(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


# The lowest bit of the CRC-32 of the decimal doc_id: its bytes go in one by one, each followed by eight steps (-1).
_CRC_BIT = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: list_prepend(ascii(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) & 1, 1)"""

_MERKLE_SQL = f"""
WITH RECURSIVE documents_cut AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC_BIT} = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents
), leaves AS (
  SELECT row_number() OVER () AS id, doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("cut")} AS other FROM documents_cut
), ranked AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r
  FROM leaves
), tree AS (
  SELECT g, 0 AS l, r AS i, leaf AS node, n FROM ranked
  UNION ALL
  SELECT g, l + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, l, i // 3, n
), subroots AS (
  SELECT g, node FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS l, g AS i, node, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT l + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY l, i // 3, n
), runs AS (
  SELECT id, l, k.r // (3 ** l)::BIGINT AS own, t.i, t.node FROM ranked k JOIN tree t ON t.g = k.g AND t.n > 1 AND t.i // 3 = k.r // (3 ** l)::BIGINT // 3
  UNION ALL
  SELECT id, l + 100, k.g // (3 ** l)::BIGINT, t.i, t.node FROM ranked k JOIN top t ON t.n > 1 AND t.i // 3 = k.g // (3 ** l)::BIGINT // 3
), path AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY l) AS s, count(*) OVER (PARTITION BY id) AS steps,
         coalesce(string_agg(node, '' ORDER BY i) FILTER (WHERE i < own), '') AS before, coalesce(string_agg(node, '' ORDER BY i) FILTER (WHERE i > own), '') AS after
  FROM runs GROUP BY id, l
), fold AS (
  SELECT id, 0::BIGINT AS s, other AS x FROM ranked
  UNION ALL
  SELECT f.id, f.s + 1, sha256(p.before || f.x || p.after) FROM fold f JOIN path p ON p.id = f.id AND p.s = f.s + 1
), proofs AS (
  SELECT id, count(*) AS steps, sha256(string_agg(before || after, '' ORDER BY s)) AS proof FROM path GROUP BY id
)
SELECT k.doc_id, k.leaf, b.node AS subroot, t.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.x AS folded_root, f.x = t.node AS verified
FROM ranked k JOIN subroots b ON b.g = k.g JOIN top t ON t.n = 1 LEFT JOIN proofs p ON p.id = k.id JOIN fold f ON f.id = k.id AND f.s = coalesce(p.steps, 0)
"""

ORACLE_SQL: dict[str, str] = {"op5_line_windows": _LINES_SQL, "op11_merkle_manifest": _MERKLE_SQL, "op12_debruijn_dedup": _SUBSTRINGS_SQL}
