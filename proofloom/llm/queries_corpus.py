"""Queries of problems 7 to 10: overlaps, token ids, leaked items and junk pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import leakage, overlap, spam, tokens
from proofloom.sources.tables import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    split = F.lower(F.trim("split"))
    train = F.when(split == "train", True).when(split.isin("valid", "test"), False)
    p = table(spark, folder, "fewshot_pool")
    return p.select(F.col("record_id").alias("id"), F.col("evidence_text").alias("text"), F.col("source_hash").alias("source"), train.alias("train"))


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.split_overlaps(_records(spark, folder))


def p7_links(spark: SparkSession, folder: str) -> DataFrame:
    """Near texts of train and of valid or test, by the first record of each text."""
    return overlap.text_links(_records(spark, folder)).select(F.col("a").alias("train_text"), F.col("b").alias("other_text"), F.round("cosine", 6).alias("cosine"))


def p7_members(spark: SparkSession, folder: str) -> DataFrame:
    """The first record with the same words for every record."""
    return overlap.text_members(_records(spark, folder)).withColumnsRenamed({"id": "record_id"})


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a train record and a valid or test record that are the same or nearly so."""
    x = _overlaps(spark, folder)
    return x.select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b")).distinct()


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records of valid and test, and those with an overlap, per split and source."""
    p = table(spark, folder, "fewshot_pool").select("record_id", "split", F.lower(F.trim("source_api")).alias("source_api")).filter(F.lower(F.trim("split")).isin("valid", "test"))
    hit = _overlaps(spark, folder).select(F.col("b").alias("record_id"), F.lit(1).alias("hit")).distinct()
    return p.join(hit, "record_id", "left").groupBy("split", "source_api").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold PASSAGE consecutive words of an item."""
    return p9_alignments(spark, folder).filter(F.col("run") >= leakage.PASSAGE).select("doc_id", "item_id")


def p9_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and item with a common seed, with alignment score and longest common run."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return leakage.leaks(docs, table(spark, folder, "eval_item").select(F.col("item_id").alias("id"), "text"))


def p9_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an item whole, edited or not, by the score of its alignment."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    x = leakage.edited_leaks(docs, table(spark, folder, "eval_item").select(F.col("item_id").alias("id"), "text"))
    return x.withColumn("share", F.round("share", 6))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Junk pages."""
    x = spam.junk_pages(table(spark, folder, "documents"))
    return x.filter((F.col("words") >= spam.LEAST_WORDS) & (F.col("junk") > spam.SHARE)).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p7_found, p7_report, p7_links, p7_members, p8_ids, p9_found, p9_alignments, p9_edited, p10_found)}
_GRAMS = r"""SELECT DISTINCT {0} AS id, unnest([list_slice(w, i, i + 14) for i in range(1, len(w) - 13)]) AS g
  FROM (SELECT {0}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {1}) WHERE len(w) >= 15"""
# word edit distance by rows of the dynamic programme: costs holds, for each word of a, the cost of each word of b
_DISTANCE = """list_last(list_reduce([[CASE WHEN x = y THEN 0 ELSE 1 END FOR y IN bw] FOR x IN aw], lambda row, cost: list_transform([
    list_prepend(row[1] + 1, [least(row[j] + cost[j], row[j + 1] + 1) FOR j IN range(1, len(cost) + 1)])],
    lambda c: [list_min([c[i] + j - i FOR i IN range(1, j + 1)]) FOR j IN range(1, len(c) + 1)])[1], range(0, len(bw) + 1)))"""
_PAIRS = f"""SELECT a, b FROM (SELECT a.id AS a, b.id AS b, a.w AS aw, b.w AS bw, a.s AS s, b.s AS r, CAST(floor(greatest(len(a.w), len(b.w)) * 15 / 100) AS BIGINT) AS most
    FROM (SELECT * FROM w WHERE split = 'train') a, (SELECT * FROM w WHERE split IN ('valid', 'test')) b)
  WHERE s = r OR (len(aw) > 0 AND len(bw) > 0 AND abs(len(aw) - len(bw)) <= most AND len([x FOR x IN aw IF NOT list_contains(bw, x)]) <= most AND {_DISTANCE} <= most)"""
_OVERLAPS = rf"""w AS (SELECT record_id AS id, lower(trim(split)) AS split, source_hash AS s, regexp_extract_all(lower(coalesce(evidence_text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM fewshot_pool),
  o AS ({_PAIRS})"""
ORACLE = {
    "p7_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(a, b) AS record_a, greatest(a, b) AS record_b FROM o",
    "p7_report": f"""WITH {_OVERLAPS} SELECT p.split, lower(trim(p.source_api)) AS source_api, count(*) AS records, count(h.b) AS overlapping
      FROM fewshot_pool p LEFT JOIN (SELECT DISTINCT b FROM o) h ON h.b = p.record_id WHERE lower(trim(p.split)) IN ('valid', 'test') GROUP BY ALL""",
    "p7_members": f"""WITH {_OVERLAPS} SELECT id AS record_id, min(id) OVER (PARTITION BY w) AS representative, count(*) OVER (PARTITION BY w) AS records FROM w
      WHERE len(w) > 0 AND split IN ('train', 'valid', 'test')""",
    "p9_found": f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({_GRAMS.format('doc_id', 'documents')}) d JOIN ({_GRAMS.format('item_id', 'eval_item')}) i USING (g)",
}
