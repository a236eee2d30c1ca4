"""The catalogue of queries over the synthetic tables, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .carrier import GT_SQL, PRED_SQL, documents, gt_regions, pred_regions
from .config import Align
from .functions import claims, text
from .operators import align, compare, dataset, layout, lines, metrics, pairs
from .plans import judge
from .sources import records, sinks, verdicts
from .stages import drop_stage, shared_dir, write_stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return gt_regions(spark, sf_dir), pred_regions(spark, sf_dir)


_EXACT_SQL = f"WITH {PRED_SQL}" + """, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY ix) AS nth FROM gt),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY ix) AS nth FROM pred),
pairs AS (SELECT g.doc_id, g.norm, g.ix AS gt_ix, p.ix AS pred_ix FROM g JOIN p USING (doc_id, norm, nth))"""

# -- readers and regions


@query(f"WITH {GT_SQL} SELECT doc_id AS source_file, ix, raw, norm FROM gt")
def regions_explode(spark, sf_dir):
    return gt_regions(spark, sf_dir)


@query(r"""SELECT doc_id, count(*) FILTER (WHERE trim(line, chr(32) || chr(9) || chr(13)) <> '') AS n_regions
FROM (SELECT doc_id, unnest(string_split(replace(text, chr(9), ' '), chr(10))) AS line FROM documents) GROUP BY doc_id""")
def regions_per_file(spark, sf_dir):
    found = records.regions_of_text(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_regions"))


@query("SELECT conv_id, turn, 0 + len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) * (turn % 3 <> 0)::INT AS n_regions FROM conversations")
def empty_token_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    marked = F.when(F.col("turn") % 3 == 0, "<EMPTY>").otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.size(records.regions_of_text(marked)).alias("n_regions"))


@query("SELECT role, turn AS record_ix, text FROM (SELECT *, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id DESC) AS r FROM conversations) WHERE r = 1")
def last_duplicate_wins(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("/", "role", "turn"))
    won = records.last_wins(c.select("key", "conv_id", "role", "turn", "text"), "key", "conv_id")
    return won.select("role", F.col("turn").alias("record_ix"), "text")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'claim' || event_id WHEN event_id % 3 = 1 THEN 'lines' || event_id ELSE 'text' || event_id END AS value FROM events""")
def first_present_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tail = lambda k: F.concat(F.lit(f'"{k}":"{k.split("_")[0]}'), "event_id", F.lit('"'))
    body = F.when(F.col("event_id") % 3 == 0, F.concat_ws(",", tail("text"), tail("lines"), tail("claim_text"))).when(F.col("event_id") % 3 == 1, F.concat_ws(",", tail("text"), tail("lines"))).otherwise(tail("text"))
    v = F.parse_json(F.concat(F.lit("{"), body, F.lit("}")))
    return e.select("event_id", F.try_variant_get(records.first_present(v, ("claim_text", "lines", "text")), "$", "string").alias("value"))


# -- text

@query(r"SELECT conv_id, turn, regexp_replace(lower(text), '\s+', '', 'g') AS joined, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9_\s]', '', 'g'), '\s+', ' ', 'g')) AS plain FROM conversations")
def normalize_ascii(spark, sf_dir):
    from .config import Normalize

    c = table(spark, sf_dir, "conversations")
    plain = text.normalize_ascii(F.col("text"), Normalize(ignore_whitespace=False, case_sensitive=True, strip_punctuation=True))
    return c.select("conv_id", "turn", text.normalize_ascii(F.col("text")).alias("joined"), plain.alias("plain"))


@query()
def normalize_unicode(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query(r"SELECT conv_id, turn, len(regexp_extract_all(text, '[a-zA-Z]+|[0-9][0-9.,%]*|[^\sa-zA-Z0-9]')) AS n_tokens FROM conversations")
def tokenize_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.size(text.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$&()*+-./:;<=>?@[]^_{|}~"


def _spelled(a: str, b: str) -> str:
    """SQL for the distance of two lists: each distinct element of both becomes a letter of one byte, as DuckDB counts bytes."""
    word = lambda x: f"array_to_string(list_transform({x}, lambda t: substr('{_LETTERS}', list_position(v, t), 1)), '')"
    return f"levenshtein({word(a)}, {word(b)})"


@query(
    f"WITH {PRED_SQL}, two AS (SELECT gt.doc_id, gt.ix, string_split(gt.norm, '') AS a, string_split(pred.norm, '') AS b "
    "FROM gt JOIN pred ON gt.doc_id = pred.doc_id AND gt.ix = pred.ix), both_ AS (SELECT *, list_distinct(list_concat(a, b)) AS v FROM two) "
    f"SELECT doc_id AS source_file, ix, {_spelled('a', 'b')} AS distance FROM both_"
)
def char_edit_distance(spark, sf_dir):
    g, p = sides(spark, sf_dir)
    both = g.join(p.select("source_file", "ix", F.col("norm").alias("b")), ["source_file", "ix"])
    return both.select("source_file", "ix", text.edit_distance(F.col("norm"), F.col("b")).alias("distance"))


_TOKENS = r"'[a-zA-Z]+|[0-9][0-9.,%]*|[^\sa-zA-Z0-9]'"


@query(
    f"WITH two AS (SELECT p_partkey, regexp_extract_all(p_name, {_TOKENS}) AS a, regexp_extract_all(p_type || ' ' || p_brand, {_TOKENS}) AS b FROM part), "
    f"both_ AS (SELECT *, list_distinct(list_concat(a, b)) AS v FROM two) SELECT p_partkey, {_spelled('a', 'b')} AS distance FROM both_"
)
def token_edit_distance(spark, sf_dir):
    """Of short texts, which SQL can spell with letters of one byte; region_token_distance has texts of any length."""
    p = table(spark, sf_dir, "part")
    a, b = text.tokenize(F.col("p_name")), text.tokenize(F.concat_ws(" ", "p_type", "p_brand"))
    return p.select("p_partkey", text.token_distance(a, b).cast("long").alias("distance"))


@query()
def region_token_distance(spark, sf_dir):
    g, p = sides(spark, sf_dir)
    both = g.join(p.select("source_file", "ix", F.col("raw").alias("b")), ["source_file", "ix"])
    # Equal texts have equal tokens; only the others are taken apart.
    tokens = lambda c: F.when(F.col("raw") == F.col("b"), F.array().cast("array<string>")).otherwise(text.tokenize(F.col(c))).alias(c)
    both = both.withColumns({"ta": tokens("raw"), "tb": tokens("b")})
    return both.select("source_file", "ix", text.list_distance(F.col("ta"), F.col("tb")).alias("distance"))


@query(
    "SELECT l_orderkey, l_linenumber, n_length, n_errors, CASE WHEN n_length > 0 THEN n_errors / n_length WHEN n_errors = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS error_rate "
    "FROM (SELECT l_orderkey, l_linenumber, (l_linenumber - 1)::BIGINT AS n_length, (l_orderkey % 3)::BIGINT AS n_errors FROM lineitem)"
)
def rate_zero_guard(spark, sf_dir):
    """Lines of an order as lengths from 0 on."""
    n, e = (F.col("l_linenumber") - 1).cast("long"), (F.col("l_orderkey") % 3).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n_length"), e.alias("n_errors"))
    return rows.withColumn("error_rate", text.rate(F.col("n_errors"), F.col("n_length")))


@query("SELECT conv_id, turn, substr(sha256('[\"m\",\"p\",\"' || role || '\",\"' || conv_id || '\"]'), 1, 32) AS key FROM conversations")
def verdict_hash(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.verdict_key(F.lit("m"), F.lit("p"), F.col("role"), F.col("conv_id").cast("string")).alias("key"))


# -- stores and inputs


@query("SELECT conv_id || '-' || role AS key, arg_max(turn % 3 = 0, turn) AS same FROM conversations GROUP BY ALL")
def verdict_store(spark, sf_dir):
    """A verdict a turn, appended a part for each third of the turns; the store is compacted and the last of a key stays."""
    c = table(spark, sf_dir, "conversations")
    path = f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    last = c.agg(F.max("turn")).first()[0] or 0
    cuts = [last // 3, 2 * last // 3, last]
    for lo, hi in zip([-1, *cuts], cuts):
        part = c.where(F.col("turn").between(lo + 1, hi)).groupBy(F.concat_ws("-", "conv_id", "role").alias("key"))
        verdicts.append_verdicts(part.agg((F.max("turn") % 3 == 0).alias("same")), path)
    verdicts.compact_verdicts(spark, path)
    return verdicts.load_verdicts(spark, path)


@query(
    r"SELECT page_id, 0::BIGINT AS item_ix, url AS path, regexp_extract(regexp_replace(url, '\?.*$', ''), '[^/]*$') AS file_name, lower(regexp_extract(url, '\.([^./]+)$', 1)) IN "
    r"('png', 'jpg', 'jpeg', 'tiff', 'bmp', 'pdf') AS image FROM pages UNION ALL SELECT page_id, 1, 'pictures/' || page_id || '.PNG', page_id || '.PNG', TRUE FROM pages"
)
def image_inputs(spark, sf_dir):
    """Every page's input is a JSON list of its address and of a picture; items are taken whatever their suffix."""
    pages = table(spark, sf_dir, "pages")
    both = F.to_json(F.array("url", F.concat(F.lit("pictures/"), F.col("page_id").cast("string"), F.lit(".PNG"))))
    items = pages.select("page_id", F.posexplode(records.input_items(both)).alias("item_ix", "path"))
    name = text.basename(F.regexp_replace("path", r"\?.*$", ""))
    return items.select("page_id", F.col("item_ix").cast("long").alias("item_ix"), "path", name.alias("file_name"), records.is_image(F.col("path")).alias("image"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(length(coalesce(text, '')))::BIGINT AS n_chars, count(*) AS n_lines FROM documents")
def json_lines_read(spark, sf_dir):
    """Documents as JSON lines, read in splits: every line is numbered once within its file."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).write.json(path)
    rows = records.read_json_lines(spark, path)
    rows = rows.select("path", "line", F.try_variant_get("record", "$.doc_id", "long").alias("doc_id"), F.try_variant_get("record", "$.text", "string").alias("text"))
    sizes = [F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars")]
    return rows.agg(*sizes, F.count_distinct("path", "line").alias("n_lines"))


# -- files

_FILES_SQL = f"WITH {PRED_SQL}, gf AS (SELECT DISTINCT doc_id FROM gt), pf AS (SELECT DISTINCT doc_id FROM pred)"


def _files(spark, sf_dir):
    g, p = sides(spark, sf_dir)
    return g.select("source_file").distinct(), p.select("source_file").distinct()


@query(_FILES_SQL + " SELECT doc_id AS source_file FROM gf SEMI JOIN pf USING (doc_id)")
def coverage_inner(spark, sf_dir):
    g, p = _files(spark, sf_dir)
    return g.join(p, "source_file", "left_semi")


@query(_FILES_SQL + " SELECT doc_id AS source_file FROM gf ANTI JOIN pf USING (doc_id)")
def coverage_anti(spark, sf_dir):
    g, p = _files(spark, sf_dir)
    return g.join(p, "source_file", "left_anti")


@query(_FILES_SQL + " SELECT count(*) AS gt_files, count(pf.doc_id) AS scored_files, count(*) - count(pf.doc_id) AS unpredicted_files FROM gf LEFT JOIN pf ON gf.doc_id = pf.doc_id")
def coverage_counts(spark, sf_dir):
    from .plans.evaluate import coverage

    return coverage(*_files(spark, sf_dir))


@query(_FILES_SQL + " SELECT doc_id AS source_file FROM gf ANTI JOIN pf USING (doc_id) ORDER BY doc_id LIMIT 5")
def topn_first_files(spark, sf_dir):
    """The report names the first five files without prediction."""
    return coverage_anti(spark, sf_dir).orderBy("source_file").limit(5)


# -- exact pass and rates


@query(_EXACT_SQL + " SELECT doc_id AS source_file, norm, gt_ix, pred_ix FROM pairs")
def exact_pass_pairs(spark, sf_dir):
    return align.exact_pairs(*sides(spark, sf_dir))


@query(_EXACT_SQL + " SELECT doc_id AS source_file, ix, norm FROM gt WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.doc_id = gt.doc_id AND gt_ix = ix)")
def exact_pass_missing(spark, sf_dir):
    g, p = sides(spark, sf_dir)
    return align.unmatched(g, align.exact_pairs(g, p), "gt").select("source_file", "ix", "norm")


@query(_EXACT_SQL + " SELECT doc_id AS source_file, ix, norm FROM pred WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.doc_id = pred.doc_id AND pred_ix = ix)")
def exact_pass_extra(spark, sf_dir):
    g, p = sides(spark, sf_dir)
    return align.unmatched(p, align.exact_pairs(g, p), "pred").select("source_file", "ix", "norm")


_PER_FILE_SQL = _EXACT_SQL + r""", m AS (SELECT doc_id, count(*) AS matched FROM pairs GROUP BY doc_id),
gs AS (SELECT doc_id, count(*) AS gt, sum(length(norm)) AS gl FROM gt GROUP BY doc_id),
ps AS (SELECT doc_id, count(*) AS pred, sum(length(norm)) AS pl FROM pred GROUP BY doc_id),
hit AS (SELECT doc_id, sum(length(norm)) AS hl FROM pairs GROUP BY doc_id),
files AS (SELECT gs.doc_id AS source_file, gt, pred, coalesce(matched, 0) AS matched, (gl - coalesce(hl, 0)) + (pl - coalesce(hl, 0)) AS char_errors, gl AS char_length
  FROM gs JOIN ps ON gs.doc_id = ps.doc_id LEFT JOIN m ON m.doc_id = gs.doc_id LEFT JOIN hit ON hit.doc_id = gs.doc_id)"""


def exact_items(spark, sf_dir) -> DataFrame:
    """Per-file counts of the exact pass alone: what is not matched is missing or extra.

    All regions of a file stay in one partitioning by file from the windows on.
    """
    g, p = sides(spark, sf_dir)
    pairs = align.exact_pairs(g, p)
    sums = lambda df, n, l: df.groupBy("source_file").agg(F.count(F.lit(1)).alias(n), F.sum(F.length("norm").cast("long")).alias(l))
    items = sums(g, "gt", "gl").join(sums(p, "pred", "pl"), "source_file").join(sums(pairs, "matched", "hl"), "source_file", "left").fillna(0, subset=["matched", "hl"])
    return items.select("source_file", "gt", "pred", "matched", (F.col("gl") + F.col("pl") - 2 * F.col("hl")).alias("char_errors"), F.col("gl").alias("char_length"))


def _rates(df: DataFrame) -> DataFrame:
    p, r, f1 = text.precision_recall(F.col("matched"), F.col("matched"), F.col("gt"), F.col("pred"))
    return df.withColumns({"cer": F.round(text.rate(F.col("char_errors"), F.col("char_length")), 4), "precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1, 4)})


_RATES = "round(char_errors / char_length, 4) AS cer, round(matched / pred, 4) AS precision, round(matched / gt, 4) AS recall, round(CASE WHEN matched > 0 THEN 2.0 * (matched / pred) * (matched / gt) / (matched / pred + matched / gt) ELSE 0.0 END, 4) AS f1"


@query(_PER_FILE_SQL + f" SELECT source_file, gt, pred, matched, char_errors::BIGINT AS char_errors, char_length::BIGINT AS char_length, {_RATES} FROM files")
def per_file_prf(spark, sf_dir):
    return _rates(exact_items(spark, sf_dir))


_SUMS = "sum(gt)::BIGINT AS gt, sum(pred)::BIGINT AS pred, sum(matched)::BIGINT AS matched, sum(char_errors)::BIGINT AS char_errors, sum(char_length)::BIGINT AS char_length"


def _sum(df: DataFrame, *by: str) -> DataFrame:
    return _rates(df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("gt", "pred", "matched", "char_errors", "char_length")]))


@query(_PER_FILE_SQL + f", s AS (SELECT source, {_SUMS} FROM files JOIN documents ON doc_id = source_file GROUP BY source) SELECT *, {_RATES} FROM s")
def corpus_cer_exact(spark, sf_dir):
    """Flagship: error rates of each source's predictions against its annotations, exact matches only."""
    sources = documents(spark, sf_dir).select(F.col("doc_id").alias("source_file"), "source")
    return _sum(exact_items(spark, sf_dir).join(sources, "source_file"), "source")


@query(_PER_FILE_SQL + f", j AS (SELECT files.*, lang, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS quality FROM files JOIN documents d ON d.doc_id = source_file JOIN labels l ON l.doc_id = d.doc_id), s AS (SELECT coalesce(lang, 'all') AS lang, coalesce(quality, 'all') AS quality, {_SUMS} FROM j GROUP BY ROLLUP (lang, quality)) SELECT *, {_RATES} FROM s")
def per_lang_source_cer(spark, sf_dir):
    """Rates by language and quality label with their subtotals."""
    of = documents(spark, sf_dir).select(F.col("doc_id").alias("source_file"), "lang").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_file"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("quality")), "source_file")
    joined = exact_items(spark, sf_dir).join(of, "source_file")
    sums = joined.rollup("lang", "quality").agg(*[F.sum(c).alias(c) for c in ("gt", "pred", "matched", "char_errors", "char_length")])
    return _rates(sums.fillna("all", subset=["lang", "quality"]))


@query(_PER_FILE_SQL + " SELECT round(sum(char_errors) / sum(char_length), 4) AS micro, round(avg(char_errors / char_length), 4) AS macro FROM files")
def micro_vs_macro(spark, sf_dir):
    items = exact_items(spark, sf_dir)
    return items.agg(F.round(F.sum("char_errors") / F.sum("char_length"), 4).alias("micro"), F.round(F.avg(F.col("char_errors") / F.col("char_length")), 4).alias("macro"))


# -- containment and similarity


def _left(spark, sf_dir):
    """What the exact pass leaves of both sides, made once."""
    left = write_stage(align.left_over(*sides(spark, sf_dir)), "left-over")
    return align.side_of(left, align.GT), align.side_of(left, align.PRED)


def _within(g: DataFrame, p: DataFrame) -> DataFrame:
    return g.select("source_file", F.col("ix").alias("gt_ix"), F.col("norm").alias("a")).join(p.select("source_file", F.col("ix").alias("pred_ix"), F.col("norm").alias("b")), "source_file")


_LEFT_SQL = _EXACT_SQL + """, lg AS (SELECT * FROM gt WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.doc_id = gt.doc_id AND gt_ix = ix)),
lp AS (SELECT * FROM pred WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.doc_id = pred.doc_id AND pred_ix = ix))"""


@query(_LEFT_SQL + " SELECT lg.doc_id AS source_file, lg.ix AS gt_ix, lp.ix AS pred_ix, instr(lp.norm, lg.norm) - 1 AS offset_ FROM lg JOIN lp ON lg.doc_id = lp.doc_id AND length(lg.norm) >= 2 AND length(lp.norm) > length(lg.norm) AND contains(lp.norm, lg.norm)")
def contains_literal(spark, sf_dir):
    near = _within(*_left(spark, sf_dir)).where((F.length("a") >= 2) & (F.length("b") > F.length("a")) & F.col("b").contains(F.col("a")))
    return near.select("source_file", "gt_ix", "pred_ix", (F.expr("instr(b, a)") - 1).cast("long").alias("offset_"))


@query(_LEFT_SQL + " SELECT lg.doc_id AS source_file, lg.ix AS gt_ix, lp.ix AS pred_ix FROM lg JOIN lp ON lg.doc_id = lp.doc_id AND 2 * least(length(lg.norm), length(lp.norm)) >= 0.9 * (length(lg.norm) + length(lp.norm))")
def length_bound_candidates(spark, sf_dir):
    near = _within(*_left(spark, sf_dir))
    return near.where(text.length_bound(F.length("a"), F.length("b"), 0.9)).select("source_file", "gt_ix", "pred_ix")


@query()
def ratio_candidates(spark, sf_dir):
    return align.ratio_candidates(*_left(spark, sf_dir), 0.55).select("source_file", "gt_ix", "pred_ix", "similarity")


@query()
def infix_candidates(spark, sf_dir):
    found = pairs.infix_candidates(*_left(spark, sf_dir))
    return found.withColumnsRenamed({"part_ix": "gt_ix", "container_ix": "pred_ix"})


def _items(spark, sf_dir, *variants: Align) -> list[DataFrame]:
    """A row a file under each of the rules, which differ in credits only: regions are aligned and held against each other once."""
    g, p = sides(spark, sf_dir)
    exact, left = align.exact_and_left(g, p)
    found = write_stage(align.resolved(left), "matches")
    sized = write_stage(metrics.sizes(g, p), "sizes")
    errors = write_stage(metrics.errors_by_kind(found, left, sized), "errors")
    return [metrics.counts_per_file(sized, exact.unionByName(found), None, None, rules, errors=errors) for rules in variants]


@query()
def align_full(spark, sf_dir):
    return align.matches(*sides(spark, sf_dir))


@query()
def chunking_accuracy(spark, sf_dir):
    return metrics.corpus(*_items(spark, sf_dir, Align())).select("chunk_located", "chunk_whole", "chunk_merged", "chunk_split", "chunking_accuracy", "cer", "wer", "precision", "recall", "f1")


def _careful() -> Callable[[str, str], bool]:
    """A stand-in for a judge: the same text if all but a tenth of the characters, counted, are."""
    from collections import Counter

    return lambda a, b: 10 * sum((Counter(a) & Counter(b)).values()) >= 9 * max(len(a), len(b))


@query()
def judge_loop(spark, sf_dir):
    """All passes with a judge that is asked, round by round, for what its verdicts leave open."""
    g, p = sides(spark, sf_dir)
    asking = judge.Asking(_careful, "careful", wait=0.0)
    found = judge.judged_matches(g, p, asking, f"{shared_dir(spark)}/judged-{uuid.uuid4().hex}")
    return found.matches.groupBy("kind", "matched_by").agg(F.count(F.lit(1)).alias("n"))


@query()
def merge_split_counts(spark, sf_dir):
    return align.matches(*sides(spark, sf_dir)).groupBy("kind", "matched_by").agg(F.count(F.lit(1)).alias("n"))


@query()
def credit_flag_variants(spark, sf_dir):
    flags = [(merge, split) for merge in (True, False) for split in (True, False)]
    items = _items(spark, sf_dir, *[Align(merge_credit=merge, split_credit=split) for merge, split in flags])
    out = None
    for (merge, split), rows in zip(flags, items):
        one = metrics.corpus(rows).select(F.lit(merge).alias("merge_credit"), F.lit(split).alias("split_credit"), "cer", "f1", "chunking_accuracy")
        out = one if out is None else out.unionByName(one)
    return out


@query(_EXACT_SQL + ", v AS (SELECT DISTINCT norm, length(norm) % 2 = 0 AS same FROM gt WHERE ix % 2 = 0) SELECT pairs.doc_id AS source_file, gt_ix, pred_ix, coalesce(v.same, false) AS same, v.norm IS NOT NULL AS known FROM pairs LEFT JOIN v USING (norm)")
def judge_table_join(spark, sf_dir):
    """Recorded verdicts are a join; what is not recorded is refused."""
    g, p = sides(spark, sf_dir)
    verdicts = g.where("ix % 2 = 0").select(F.col("norm").alias("_n"), (F.length("norm") % 2 == 0).alias("said")).distinct()
    joined = align.exact_pairs(g, p).join(verdicts, F.col("norm") == F.col("_n"), "left")
    return joined.select("source_file", "gt_ix", "pred_ix", F.coalesce("said", F.lit(False)).alias("same"), F.col("_n").isNotNull().alias("known"))


# -- claims and boxes


@query("SELECT p_partkey, (regexp_matches(replace(p_type, ' ', ''), 'BRASS|STEEL|COPPER') OR regexp_matches(replace(p_name, ' ', ''), '[0-9]+')) AND NOT regexp_matches(replace(p_type, ' ', ''), 'SMALL|^PROMO') AND lower(p_brand) NOT IN ('brand#11', 'brand#12') AS keep FROM part")
def claim_gate_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    by_type = claims.gate(F.col("p_type"), ["BRASS", "STEEL", "COPPER"], ["SMALL", "^PROMO"])
    by_name = claims.gate(F.col("p_name"), ["[0-9]+"], []) & ~claims.matches(F.regexp_replace("p_type", " ", ""), ["SMALL", "^PROMO"])
    return p.select("p_partkey", ((by_type | by_name) & ~F.lower("p_brand").isin("brand#11", "brand#12")).alias("keep"))


@query(f"WITH {GT_SQL} SELECT doc_id AS source_file, ix, regexp_matches(replace(raw, ' ', ''), 'tion|ing[^a-z]|[0-9]+%') AND NOT regexp_matches(replace(raw, ' ', ''), '^[0-9]{{8,}}$|worth') AS keep FROM gt")
def claim_gate_docs(spark, sf_dir):
    g = gt_regions(spark, sf_dir)
    keep = claims.gate(F.col("raw"), ["tion", "ing[^a-z]", "[0-9]+%"], ["^[0-9]{8,}$", "worth"])
    return g.select("source_file", "ix", keep.alias("keep"))


_CLAIM_PARTS = ("保湿", "净含量50ml", "平滑 ", "SkinCeuticals", "修丽可", "¥ 99", "使用前后", "12345678", "28天", "water", "规格 保湿")


def _claim_sample(spark, sf_dir) -> DataFrame:
    """A line for each part: a phrase by its number, before its name."""
    words = F.array(*map(F.lit, _CLAIM_PARTS))
    k = F.col("p_partkey") % len(_CLAIM_PARTS)
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.get(words, k.cast("int")), name).alias("line"))


_CLAIM_SQL = (
    "WITH l AS (SELECT p_partkey, [" + ", ".join(f"'{x}'" for x in _CLAIM_PARTS) + f"][p_partkey % {len(_CLAIM_PARTS)} + 1] "
    "|| CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name ELSE '' END AS line FROM part), b AS (SELECT *, regexp_replace(line, '\\s+', '', 'g') AS bare FROM l) "
    f"SELECT p_partkey, regexp_matches(bare, '{'|'.join([*claims.CLAIM_WORDS, claims.CLAIM_QUANTITY])}') "
    f"AND NOT regexp_matches(bare, '{'|'.join([*claims.EXCLUDED, *claims.EXCLUDED_WORDS])}') AND lower(bare) NOT IN ('skinceuticals', '修丽可') AS keep FROM b"
)


@query(_CLAIM_SQL)
def claim_words(spark, sf_dir):
    """The claim rules themselves, with the default brands."""
    lines_ = _claim_sample(spark, sf_dir)
    kept = claims.claim_lines(F.array("line"))
    return lines_.select("p_partkey", (F.size(kept) > 0).alias("keep"))


def boxes(spark, sf_dir) -> DataFrame:
    """A page for each conversation, with a box for each word of a turn, placed by simple arithmetic."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    x, y, h = F.col("i") * 60.0 + F.col("turn") % 3 * 5, F.col("turn") * 20.0 + F.col("i") % 2 * 3, 8.0 + F.col("i") % 4
    wide = F.length("word") * 5.0
    return c.select(F.col("conv_id").alias("page"), F.col("word").alias("text"), ((F.col("i") * 7 + F.col("turn")) % 10 / 10).alias("confidence"), x.alias("x_min"), y.alias("y_min"), (x + wide).alias("x_max"), (y + h).alias("y_max"), F.lit(1200).alias("image_height"), "turn", F.col("i").cast("long").alias("i"))


_BOXES_SQL = """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations),
c AS (SELECT conv_id, turn, i - 1 AS i, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
boxes AS (SELECT conv_id AS page, word AS text, ((i * 7 + turn) % 10) / 10 AS confidence, i * 60.0::DOUBLE + turn % 3 * 5 AS x_min, turn * 20.0::DOUBLE + i % 2 * 3 AS y_min, i * 60.0::DOUBLE + turn % 3 * 5 + length(word) * 5.0::DOUBLE AS x_max, turn * 20.0::DOUBLE + i % 2 * 3 + 8 + i % 4 AS y_max, turn, i FROM c)"""


@query(_BOXES_SQL + " SELECT page, turn, i, text FROM boxes WHERE text <> '' AND confidence >= 0.5 AND (y_max - y_min) / 1200 >= 0.008")
def box_filter(spark, sf_dir):
    return layout.filter_boxes(boxes(spark, sf_dir)).select("page", "turn", "i", "text")


@query(_BOXES_SQL + """, g AS (SELECT *, x_min - lag(x_max) OVER o > 0.8 * greatest(y_max - y_min, lag(y_max - y_min) OVER o) AS wide FROM boxes WINDOW o AS (PARTITION BY page, turn ORDER BY x_min, y_min, text))
SELECT page, turn AS line_ix, trim(string_agg(CASE WHEN coalesce(wide, false) THEN ' ' ELSE '' END || text, '' ORDER BY x_min, y_min, text)) AS text FROM g GROUP BY page, turn""")
def render_line_lag(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("line_ix", F.col("turn"))
    return layout.render_lines(b)


@query()
def line_clustering(spark, sf_dir):
    return layout.render_lines(layout.cluster_lines(layout.filter_boxes(boxes(spark, sf_dir))))


# -- two-stage lines


def _dialogs(spark, sf_dir) -> DataFrame:
    """(file_name, texts): a conversation's texts in order, every fourth one blank."""
    c = table(spark, sf_dir, "conversations")
    body = F.when(F.col("turn") % 4 == 3, F.lit("  ")).otherwise(F.trim("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("t")))), lambda x: x["t"])
    return c.groupBy(F.col("conv_id").alias("file_name")).agg(ordered.alias("texts"))


_DIALOG_SQL = """WITH d AS (SELECT conv_id AS file_name, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE trim(text) END AS t FROM conversations),
n AS (SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY turn) AS line_id, t AS text FROM d WHERE t <> '')"""


@query(_DIALOG_SQL + " SELECT file_name, line_id, text FROM n")
def blank_renumber(spark, sf_dir):
    d = _dialogs(spark, sf_dir).select("file_name", F.explode(lines.number_lines(F.col("texts"))).alias("l"))
    return d.select("file_name", F.col("l.line_id").cast("long").alias("line_id"), "l.text")


@query(_DIALOG_SQL + " SELECT file_name, count(*) FILTER (WHERE t = '') AS n_blank, count(*) FILTER (WHERE t = '') > 1 AS again FROM d GROUP BY file_name")
def blank_count_flag(spark, sf_dir):
    return _dialogs(spark, sf_dir).select("file_name", lines.blank_count(F.col("texts")).cast("long").alias("n_blank"), lines.needs_retry(F.col("texts"), 1).alias("again"))


def _stages(spark, sf_dir) -> DataFrame:
    """Numbered lines and a stage-2 reply that covers only every line whose id is not a multiple of three."""
    d = _dialogs(spark, sf_dir).select("file_name", lines.number_lines(F.col("texts")).alias("lines"))
    some = F.filter("lines", lambda x: x["line_id"] % 3 != 0)
    merged = F.transform(some, lambda x, i: F.struct((i + 1).cast("int").alias("merged_id"), F.array(x["line_id"]).alias("original_line_ids"), x["text"].alias("merged_text"))).cast(lines.MERGED)
    return d.withColumn("merged", merged)


@query(_DIALOG_SQL + " SELECT file_name, line_id FROM n WHERE line_id % 3 = 0")
def coverage_missing_ids(spark, sf_dir):
    d = _stages(spark, sf_dir).select("file_name", F.explode(lines.missing_ids(F.col("lines"), F.col("merged"))).alias("line_id"))
    return d.select("file_name", F.col("line_id").cast("long").alias("line_id"))


@query(_DIALOG_SQL + " SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY (line_id % 3 = 0)::INT, line_id) AS merged_id, line_id, text AS merged_text FROM n")
def coverage_fallback_append(spark, sf_dir):
    s = _stages(spark, sf_dir)
    out = lines.consolidate(s.select("file_name", "lines"), s.select("file_name", F.col("merged").alias("merged_lines")))
    m = out.select("file_name", F.explode("merged_lines").alias("m"))
    return m.select("file_name", F.col("m.merged_id").cast("long").alias("merged_id"), F.col("m.original_line_ids")[0].cast("long").alias("line_id"), "m.merged_text")


@query(_DIALOG_SQL + ", f AS (SELECT file_name, count(*) FILTER (WHERE line_id % 3 = 0) AS lost, count(*) AS n_lines FROM n GROUP BY file_name) SELECT file_name || CASE WHEN lost > 0 THEN ' (Manual Revision Needed)' ELSE '' END AS file_name, n_lines, CASE WHEN lost > 0 THEN 'Manual Revision Needed' END AS status FROM f")
def simplify_flag_sort(spark, sf_dir):
    s = _stages(spark, sf_dir).where(F.size("lines") > 0).withColumn("file_name", F.col("file_name").cast("string"))
    out = lines.consolidate(s.select("file_name", "lines"), s.select("file_name", F.col("merged").alias("merged_lines")))
    return lines.simplify(out).select("file_name", F.size("lines").cast("long").alias("n_lines"), "status")


# -- datasets


@query("WITH r AS (SELECT row_number() OVER (ORDER BY (doc_id * 7919) % 10007, doc_id) AS n, count(*) OVER () AS total FROM documents) SELECT CASE WHEN n <= total // 10 THEN 'test' WHEN n <= 2 * (total // 10) THEN 'eval' ELSE 'train' END AS split, count(*) AS n FROM r GROUP BY 1")
def split_exact_sizes(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    return dataset.exact_split(docs, "doc_id", order=F.col("doc_id") * 7919 % 10007).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey) AS n, count(*) OVER () AS total FROM orders) "
    "SELECT o_orderkey, CASE WHEN n <= total // 10 THEN 'test' WHEN n <= 2 * (total // 10) THEN 'eval' ELSE 'train' END AS split FROM r"
)
def split_membership(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return dataset.exact_split(orders, "o_orderkey", order=F.col("o_orderkey") * 7919 % 1000003, rows=64)


@query()
def split_by_hash(spark, sf_dir):
    return dataset.exact_split(documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file_name")))


@query(_DIALOG_SQL + ", j AS (SELECT file_name, string_agg(text, chr(10) ORDER BY line_id) AS answer FROM n GROUP BY file_name) SELECT 'root/' || file_name AS image, role, kind, CASE kind WHEN 'text' THEN CASE role WHEN 'user' THEN 'Read.' ELSE answer END END AS text FROM j, (VALUES ('user', 'image'), ('user', 'text'), ('assistant', 'text')) AS t(role, kind)")
def chat_records(spark, sf_dir):
    d = _dialogs(spark, sf_dir).select(F.col("file_name").cast("string").alias("file_name"), dataset.clean_lines(F.col("texts")).alias("lines")).where(F.col("lines")[0] != dataset.EMPTY)
    turns = dataset.chat_records(d, "root", "Read.").select(F.col("images")[0].alias("image"), F.explode("messages").alias("m"))
    return turns.select("image", "m.role", F.explode("m.content").alias("c")).select("image", "role", F.col("c.type").alias("kind"), "c.text")


# -- comparison


_MODELS_SQL = "WITH m AS (SELECT event_type AS model, value AS seconds, value * 2 + 1 AS cost FROM events)"


def _models(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("seconds"), (F.col("value") * 2 + 1).alias("cost"))


@query(_MODELS_SQL + " SELECT model, round(avg(seconds), 6) AS seconds, round(avg(cost), 6) AS cost FROM m GROUP BY model")
def model_metric_means(spark, sf_dir):
    means = compare.model_means(_models(spark, sf_dir), ["seconds", "cost"])
    return means.select("model", F.round("seconds", 6).alias("seconds"), F.round("cost", 6).alias("cost"))


@query(_MODELS_SQL + " SELECT model, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT model, avg(seconds) AS seconds, avg(cost) AS cost FROM m GROUP BY model) ON seconds, cost INTO NAME metric VALUE value)")
def unpivot_metrics(spark, sf_dir):
    long = compare.melt(compare.model_means(_models(spark, sf_dir), ["seconds", "cost"]), ["model"], ["seconds", "cost"])
    return long.select("model", "metric", F.round("value", 6).alias("value"))


@query(_MODELS_SQL + ", a AS (SELECT model, avg(seconds) AS seconds, avg(cost) AS cost FROM m GROUP BY model) SELECT model, round(1 - (seconds - min(seconds) OVER ()) / (max(seconds) OVER () - min(seconds) OVER ()), 5) AS seconds, round((cost - min(cost) OVER ()) / (max(cost) OVER () - min(cost) OVER ()), 5) AS cost FROM a")
def minmax_inverse(spark, sf_dir):
    scaled = compare.min_max(compare.model_means(_models(spark, sf_dir), ["seconds", "cost"]), ["seconds", "cost"], ["seconds"])
    return scaled.select("model", F.round("seconds", 5).alias("seconds"), F.round("cost", 5).alias("cost"))


@query(_MODELS_SQL + " SELECT model, count(seconds) AS n, round(sum(seconds), 4) AS total, round(avg(seconds), 6) AS mean, round(median(seconds), 6) AS median, min(seconds) AS least, max(seconds) AS most FROM m GROUP BY model")
def latency_stats(spark, sf_dir):
    s = compare.latency(_models(spark, sf_dir), "seconds", "model")
    return s.select("model", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "least", "most")


@query("SELECT conv_id, turn, '| ' || role || ' | ' || replace(text, chr(10), '<br>') || ' |' AS row_ FROM conversations")
def report_markdown_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sinks.markdown_row(F.col("role"), F.col("text")).alias("row_"))


@query("SELECT seconds_bin AS bin, count(*) AS n FROM (SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10)::BIGINT + 1 END AS seconds_bin FROM events WHERE value IS NOT NULL) GROUP BY 1")
def value_histogram(spark, sf_dir):
    return compare.histogram(table(spark, sf_dir, "events").where("value is not null"), "value", 0, 100, 10)


@query(
    "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'http://h' || conv_id || '/v1/chat/completions' WHEN turn % 4 = 1 THEN 'http://h' || conv_id || '/v2/chat/completions' "
    "ELSE 'http://h' || conv_id || '/v1/chat/completions' END AS url FROM conversations"
)
def chat_urls(spark, sf_dir):
    host = F.concat(F.lit("http://h"), F.col("conv_id").cast("string"))
    tail = F.when(F.col("turn") % 4 == 0, "/v1/").when(F.col("turn") % 4 == 1, "/v2").when(F.col("turn") % 4 == 2, "/").otherwise("/v1/chat/completions")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.chat_url(F.concat(host, tail)).alias("url"))


@query("SELECT event_id, strftime(make_timestamp(event_id * 86461000000), '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def iso_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.local_timestamp(F.timestamp_seconds(F.col("event_id") * 86461)).alias("at"))


@query(_EXACT_SQL + ", c AS (SELECT norm, count(*) AS n FROM pairs GROUP BY norm) SELECT coalesce(sum((length(norm) % 3 = 1)::INT), 0)::BIGINT AS judge_calls, "
       "coalesce(sum(CASE WHEN length(norm) % 3 = 0 THEN n WHEN length(norm) % 3 = 1 THEN n - 1 ELSE 0 END), 0)::BIGINT AS judge_cache_hits, coalesce(sum(CASE WHEN length(norm) % 3 = 2 THEN n ELSE 0 END), 0)::BIGINT AS judge_failures FROM c")
def judge_tallies(spark, sf_dir):
    """Exact pairs stand for deferred ones here: a text's length says whether its verdict is cached, given or missing."""
    g, p = (df.withColumn("raw", F.col("norm")) for df in sides(spark, sf_dir))
    one = lambda c: F.array(F.col(c))
    pairs = align.exact_pairs(g, p).select("source_file", F.lit("uncertain").alias("kind"), one("gt_ix").alias("gt_ixs"), one("pred_ix").alias("pred_ixs"))
    known = lambda rest: g.where(F.length("norm") % 3 == rest).select(F.col("norm").alias("gt"), F.col("norm").alias("pred"))
    return align.judge_tallies(pairs, (g, p), known(0), known(1))


def _unlike(spark, sf_dir, kinds: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matches of these kinds, none of which is exact, written, and both sides."""
    g, p = sides(spark, sf_dir)
    left = write_stage(align.left_over(g, p), "left-over")
    found = write_stage(align.resolved(left).where(kinds), "matches")
    drop_stage(left)
    return found, g, p


@query()
def rejected_listing(spark, sf_dir):
    return align.rejected_pairs(*_unlike(spark, sf_dir, "kind = 'uncertain'"))


@query()
def group_listing(spark, sf_dir):
    return align.group_texts(*_unlike(spark, sf_dir, "kind in ('merge', 'split')"))
