"""The queries of the text operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import labelled, language_mixture, license_search, line_runs, mixing, piecewise_hash, quality_rules, quality_trees, simhash_vp, spm_bpe, toxicity_fm

RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), labelled.remainder(F.col("doc_id"), 4) == 2
    model = language_mixture.learn(docs.select("doc_id", "text", "lang").where(~held))
    return language_mixture.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "mixture")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.dedup_lines(table(spark, sf_dir, "documents"), batches=4, text_out=False).drop("text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op6_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), labelled.remainder(F.col("doc_id"), 5) == 0
    machine = toxicity_fm.learn(labelled.examples(docs, table(spark, sf_dir, "labels"), "toxic", ~held))
    return toxicity_fm.score(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), labelled.remainder(F.col("doc_id"), 5) == 0
    trees = quality_trees.learn(labelled.examples(docs, table(spark, sf_dir, "labels"), "quality", ~held))
    return quality_trees.score(docs, trees).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_search.scan_licenses(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spm_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids_out=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_language_id, op2_simhash_near_dedup, op3_source_mix, op4_line_dedup, op5_quality_rules, op6_piecewise_hash, op7_toxicity, op8_quality, op9_license_scan, op10_byte_bpe, pipeline,
    )
    return {f.__name__: f for f in ops}


_OP3 = """
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, row_number() OVER o AS k,
        (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
f AS (SELECT arg_min(level, k) AS level FROM l WHERE 2 * source_size > level * w),
t AS (SELECT l.source, source_size::BIGINT AS source_size,
        CASE WHEN source_size = 0 THEN 0.0 WHEN f.level IS NULL THEN 2 * source_size ELSE least(2 * source_size, f.level * w) END::DOUBLE AS target
      FROM l, f),
o AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) END AS own FROM d),
g AS (SELECT source, own, sum(size)::BIGINT AS words FROM o GROUP BY ALL),
h AS (SELECT g.*, (target - 2 * coalesce(sum(words) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / nullif(sum(own * words) OVER (k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS unit
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source WINDOW k AS (PARTITION BY g.source ORDER BY own DESC)),
u AS (SELECT source, arg_max(unit, own) FILTER (unit * own < 2) AS unit FROM h GROUP BY source),
r AS (SELECT o.doc_id, o.source, o.size, t.source_size, t.target,
        CASE WHEN own = 0 THEN 0.0 WHEN unit IS NULL THEN 2.0 ELSE least(2.0::DOUBLE, unit * own) END::DOUBLE AS e,
        (('0x' || substr(md5('mix:' || coalesce(o.doc_id::VARCHAR, 'null') || ':' || o.h), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source JOIN u ON o.source IS NOT DISTINCT FROM u.source),
q AS (SELECT *, e - floor(e) AS p, sum(floor(e) * size) OVER (PARTITION BY source) AS whole_words,
        (u / (1 - u)) * ((1 - (e - floor(e))) / greatest(e - floor(e), 1e-12::DOUBLE)) AS odds FROM r),
c AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY p = 0, odds / (1 + odds), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM q),
n AS (SELECT *, (floor(e) + CASE WHEN p > 0 AND upto - size / 2.0 <= target - whole_words THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM n
"""

_OP4 = """
WITH d AS (SELECT doc_id, coalesce(doc_id, -9223372036854775807 - 1) AS own, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, own, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(own) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT own) >= 5),
m AS (SELECT k.*, f.last IS NOT NULL AND k.own < f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

_OP5 = """
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS lines FROM t),
p AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, {'a': a, 'b': lead(a) OVER x, 'c': lead(a, 2) OVER x} AS win, lead(a, 2) OVER x IS NOT NULL AS whole FROM p WINDOW x AS (PARTITION BY r ORDER BY i)),
b AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g WHERE whole) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM b, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
        length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS capitals
      FROM w LEFT JOIN c USING (r)),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines OR 2 * capitals > word_chars) AS kept
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": _OP3, "op4_line_dedup": _OP4, "op5_quality_rules": _OP5}
