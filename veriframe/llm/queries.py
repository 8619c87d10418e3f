"""The registered queries of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import bpe, embdedup, htmltext, langid, linededup, media, mixing, ngramlm, simhash, toxicity
from veriframe.llm.common import table


#: The tokenizer of op8, as the package of public tokenizers names it.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op3_mincut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 3))


def op7_projection_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.without_repeats(docs).select("doc_id", "n_units", F.size("spans").alias("n_removed"), F.size(F.filter("spans", lambda x: x["words"] >= linededup.PARAGRAPH)).alias("n_passages"), F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"]), F.lit(0)).alias("removed_chars"), "spans", "text")


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.scores(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9) AS h
  FROM documents),
own AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM docs GROUP BY source),
-- reshare the excess by weight until no target is above twice its source's size
share AS (
  SELECT 0 AS step, source, source_size, weight, false AS full_up,
         1.5 * sum(source_size) OVER () * weight / sum(weight) OVER () AS target
  FROM own
  UNION ALL
  SELECT step + 1, source, source_size, weight, is_full,
         CASE WHEN is_full THEN 2.0 * source_size
              ELSE (1.5 * sum(source_size) OVER () - sum(CASE WHEN is_full THEN 2.0 * source_size ELSE 0 END) OVER ()) * weight
                   / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END
  FROM (SELECT *, full_up OR target > 2.0 * source_size AS is_full FROM share WHERE step < 60)),
goal AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS base,
         CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS rest
  FROM share WHERE step = 60),
bucket AS (SELECT source, h, sum(size) AS words FROM docs GROUP BY source, h),
run AS (
  SELECT source, h, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM bucket),
edge AS (
  SELECT r.source, max({'h': h, 'before': before, 'words': words}) AS e
  FROM run r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source WHERE before <= rest GROUP BY r.source)
SELECT d.doc_id, d.size, g.source_size, round(g.target, 3) AS target,
       (d.size * c.copies)::BIGINT AS taken, c.copies
FROM docs d
JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
JOIN edge x ON d.source IS NOT DISTINCT FROM x.source
CROSS JOIN LATERAL (SELECT (g.base + CASE WHEN g.base < 2 AND (d.h < x.e.h OR (d.h = x.e.h AND x.e.before + x.e.words - g.rest < g.rest - x.e.before)) THEN 1 ELSE 0 END)::INT AS copies) c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_conv_toxicity,
        op2_jpeg_media,
        op3_mincut_text,
        op4_simhash_bktree,
        op5_centroid_langid,
        op6_source_mixing,
        op7_projection_neardup,
        op8_byte_bpe,
        op9_line_dedup,
        op10_backoff_lm,
    )
}

ORACLE_SQL: dict[str, str] = {"op6_source_mixing": OP6_SQL}
