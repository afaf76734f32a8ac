"""Queries of problems 1 and 6: look-alike texts and copies hidden by formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import formatting, lookalike
from proofloom.sources.tables import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "evidence").select(F.lit("evidence").alias("table_name"), F.col("evidence_hash").alias("key"), "text")
    b = table(spark, folder, "fewshot_pool").select(F.lit("fewshot_pool").alias("table_name"), F.col("record_id").alias("key"), F.col("evidence_text").alias("text"))
    return a.unionByName(b)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of one table that look the same."""
    return lookalike.lookalike_pairs(_texts(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every class of texts that look the same, with its keys, spellings and links."""
    return lookalike.lookalike_classes(_texts(spark, folder))


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every text of both tables."""
    return lookalike.consistent(_texts(spark, folder)).select("table_name", "key", "form")


def p6_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One row per group of copies: its first evidence and the number of evidences."""
    return _copies(spark, folder).select(F.col("first").alias("first_hash"), F.col("n").alias("copies")).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every evidence that is a copy of a smaller one."""
    return _copies(spark, folder).filter("key <> first").select(F.col("first").alias("first_hash"), F.col("key").alias("evidence_hash")).distinct()


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "evidence")
    return formatting.formatting_copies(e.select(F.col("evidence_hash").alias("key"), F.col("source_api").alias("source"), "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p1_classes, p6_found, p6_copies)}

_PLAIN = r"'[\p{P}\p{Z}\s\x1c-\x1f\x85]+'"


def _stripped(c: str) -> str:
    return f"regexp_replace(lower(upper({c})), {_PLAIN}, '', 'g')"


_CANON = f"""SELECT DISTINCT evidence_hash, {_stripped("coalesce(source_api, '')")} AS s,
  CASE WHEN len(p) > 0 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '^[\\s\\p{{P}}\\p{{Z}}]*[\\p{{L}}\\p{{N}}_-]+[\\s\\p{{Z}}]*='))) = 0
    THEN array_to_string(list_sort(list_transform(p, lambda x: {_stripped("x")})), ';') ELSE {_stripped("text")} END AS c
  FROM (SELECT *, list_filter(string_split(text, ';'), lambda x: {_stripped("x")} <> '') AS p FROM evidence WHERE text IS NOT NULL AND evidence_hash IS NOT NULL)"""
_GROUPS = f"SELECT evidence_hash, min(evidence_hash) OVER (PARTITION BY s, c) AS first_hash, count(*) OVER (PARTITION BY s, c) AS copies FROM ({_CANON}) WHERE c <> ''"
_SPACES = "chr(160)||chr(8194)||chr(8195)||chr(8199)||chr(8201)||chr(8202)||chr(8239)||chr(12288)"
_FORM = f"""nfc_normalize(replace(replace(replace(replace(translate(translate(nfc_normalize(regexp_replace(x, '[­͏᠎​-‏⁠-⁤﻿]', '', 'g')),
  '{lookalike.CYRILLIC}{lookalike.GREEK}µ', '{lookalike.CYRILLIC_AS}{lookalike.GREEK_AS}μ'),
  {_SPACES}||'{"".join(chr(i) for i in range(0xFF01, 0xFF5F)).replace(chr(0xFF07), "")}', '        {"".join(chr(i) for i in range(0x21, 0x7F)).replace("'", "")}'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'))"""
_FORMS = f"""SELECT table_name, key, x, {_FORM} AS form FROM (
  SELECT 'evidence' AS table_name, evidence_hash AS key, text AS x FROM evidence UNION ALL SELECT 'fewshot_pool', record_id, evidence_text FROM fewshot_pool)"""
ORACLE = {
    "p1_forms": f"SELECT table_name, key, form FROM ({_FORMS})",
    "p1_found": f"WITH f AS ({_FORMS}) SELECT DISTINCT a.table_name, a.key AS key_a, b.key AS key_b FROM f a JOIN f b ON a.table_name = b.table_name AND a.form = b.form AND a.key < b.key AND a.x <> b.x WHERE a.form <> '' AND a.x <> '' AND b.x <> ''",
    "p1_classes": f"""WITH f AS (SELECT DISTINCT table_name, key, x, form FROM ({_FORMS}) WHERE form <> '' AND x <> '' AND key IS NOT NULL),
      c AS (SELECT table_name, form, min(key) AS first_key, count(DISTINCT key) AS keys, count(DISTINCT x) AS spellings FROM f GROUP BY ALL HAVING count(DISTINCT x) > 1),
      l AS (SELECT a.table_name, a.form, count(*) AS links FROM f a JOIN f b ON a.table_name = b.table_name AND a.form = b.form AND a.x < b.x AND a.key <> b.key GROUP BY ALL)
      SELECT table_name, first_key, keys, spellings, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (table_name, form)""",
    "p6_found": f"SELECT DISTINCT first_hash, evidence_hash FROM ({_GROUPS}) WHERE evidence_hash <> first_hash",
    "p6_copies": f"SELECT DISTINCT first_hash, copies FROM ({_GROUPS})",
}
