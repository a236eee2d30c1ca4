"""The jobs as queries: each runs its job twice into a folder of its own and returns the whole output after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import score_predictions, training_set
from regionspark.sources.records import regions_of_text
from regionspark.stages import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "job1")
    for _ in range(2):
        training_set.build(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{out}/set")
    rows = training_set.read_back(spark, f"{out}/set")
    answer = F.get(F.get("messages", 1)["content"], 0)["text"]
    return rows.select("doc_id", "split", "lang", "source", "n_lines", F.get("images", 0).alias("image"), F.sha2(answer, 256).alias("answer_sha256"))


def predictions(documents: DataFrame) -> DataFrame:
    """Predictions made from the lines of documents: some dropped, some misread; every ninth document has none, every fifth
    has an older record too."""
    k = lambda i: F.col("doc_id") * 31 + i
    read = lambda x, i: F.when(k(i) % 13 == 3, F.lit(None)).when(k(i) % 7 == 2, F.replace(x, F.lit("th"), F.lit("t"))).otherwise(x)
    own = documents.where("doc_id % 9 <> 4").withColumn("regions", regions_of_text(F.col("text")))
    new = own.select(F.col("doc_id").alias("source_file"), F.lit(1).cast("long").alias("record_ix"), F.filter(F.transform("regions", read), lambda x: x.isNotNull()).alias("regions"))
    old = own.where("doc_id % 5 = 0").select(F.col("doc_id").alias("source_file"), F.lit(0).cast("long").alias("record_ix"), F.reverse("regions").alias("regions"))
    return new.unionByName(old)


def job2_score_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, documents = folder(spark, "job2"), f"{sf_dir}/documents.parquet"
    predictions(spark.read.parquet(documents)).write.parquet(f"{out}/predictions")
    for _ in range(2):
        score_predictions.run(spark, documents, f"{out}/predictions", f"{out}/scores", f"{out}/checkpoint")
    rows = score_predictions.read_back(spark, f"{out}/scores")
    return rows.withColumns({c: F.round(c, 4) for c in ("cer", "wer", "precision", "recall", "f1")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "job1_training_set": job1_training_set,
    "job2_score_predictions": job2_score_predictions,
}

# Lines as str.splitlines sees them, without Unicode white space at their ends.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_LINES = rf"""pieces AS (
  SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{{2028}}\x{{2029}}]') AS parts FROM documents WHERE doc_id IS NOT NULL
), lines AS (
  SELECT doc_id, i, regexp_replace(part, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM pieces)
)"""

_TRAINING_SQL = f"""
WITH {_LINES}, answers AS (
  SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> '') AS answer FROM lines GROUP BY doc_id
), ruled_out AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 0 OR toxic = 1
), ranked AS (
  SELECT d.doc_id, lang, source, n, answer, row_number() OVER (ORDER BY (d.doc_id * 7919) % 1000003, d.doc_id) AS rank, count(*) OVER () AS total
  FROM documents d JOIN answers USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM ruled_out WHERE doc_id IS NOT NULL)
)
SELECT doc_id, CASE WHEN rank <= floor(total * 0.1::DOUBLE) THEN 'test' WHEN rank <= 2 * floor(total * 0.1::DOUBLE) THEN 'eval' ELSE 'train' END AS split,
       lang, source, greatest(n, 1) AS n_lines, 'images/' || doc_id || '.png' AS image, sha256(coalesce(answer, '<EMPTY>')) AS answer_sha256
FROM ranked
"""

_TOKEN = r"[a-zA-Z]+|[0-9][0-9.,%]*|[^\s\x0b\x85\p{Z}a-zA-Z0-9]"
_RATES = """round(CASE WHEN char_length > 0 THEN char_errors / char_length WHEN char_errors = 0 THEN 0 ELSE 1 END, 4) AS cer,
       round(CASE WHEN token_length > 0 THEN token_errors / token_length WHEN token_errors = 0 THEN 0 ELSE 1 END, 4) AS wer,
       round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1"""
_SCORES_SQL = rf"""
WITH {_LINES}, gt AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ix, line FROM lines WHERE line <> '' AND line <> '<EMPTY>'
), both_sides AS (
  SELECT doc_id, line, 1 AS g, 0 AS p FROM gt
  UNION ALL
  SELECT doc_id, CASE WHEN (doc_id * 31 + ix) % 7 = 2 THEN replace(line, 'th', 't') ELSE line END, 0, 1 FROM gt WHERE (doc_id * 31 + ix) % 13 <> 3
), texts AS (
  SELECT doc_id, lower(regexp_replace(line, '[\s\x0b]+', '', 'g')) AS norm, sum(g) AS g, sum(p) AS p FROM both_sides GROUP BY ALL
), sized AS (
  SELECT *, least(g, p) AS m, length(norm) AS c, len(regexp_extract_all(norm, '{_TOKEN}')) AS t FROM texts
), files AS (
  SELECT d.doc_id AS source_file, d.lang, d.source, coalesce(sum(g), 0) AS gt, coalesce(sum(p), 0) AS pred, coalesce(sum(m), 0) AS m,
         coalesce(sum(c * (g + p - 2 * m)), 0) AS char_errors, coalesce(sum(c * g), 0) AS char_length,
         coalesce(sum(t * (g + p - 2 * m)), 0) AS token_errors, coalesce(sum(t * g), 0) AS token_length
  FROM documents d LEFT JOIN sized ON d.doc_id = sized.doc_id WHERE d.doc_id % 9 <> 4 GROUP BY ALL
), levels AS (
  SELECT 'file' AS level, source_file, lang, source, 1 AS n_files, gt, pred, m, char_errors, char_length, token_errors, token_length FROM files
  UNION ALL
  SELECT 'source', NULL, lang, source, count(*), sum(gt), sum(pred), sum(m), sum(char_errors), sum(char_length), sum(token_errors), sum(token_length)
  FROM files GROUP BY lang, source
), rated AS (
  SELECT *, CASE WHEN pred > 0 THEN m / pred ELSE 1 END AS p, CASE WHEN gt > 0 THEN m / gt ELSE 1 END AS r FROM levels
)
SELECT level, source_file, lang, source, n_files::BIGINT AS n_files, gt::BIGINT AS gt, pred::BIGINT AS pred, m::BIGINT AS matched_gt, m::BIGINT AS matched_pred,
       char_errors::BIGINT AS char_errors, char_length::BIGINT AS char_length, token_errors::BIGINT AS token_errors, token_length::BIGINT AS token_length,
       {_RATES}
FROM rated
"""

ORACLE_SQL: dict[str, str] = {"job1_training_set": _TRAINING_SQL, "job2_score_predictions": _SCORES_SQL}
