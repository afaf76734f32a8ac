"""Queries of problems 2, 5 and 7 over the pool of curated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import sampling, splits
from proofloom.sources.tables import table

FIELDS = ["tag", "stmt_type", "source_api"]


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    keys = F.array(F.concat(F.lit("p"), splits.digits("pmid")), F.concat(F.lit("m"), splits.number("matches_hash")))
    return table(spark, folder, "fewshot_pool").select(F.col("record_id").alias("id"), keys.alias("keys"), sampling.label("tag").alias("label"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The new split of every record, with the first record of its group."""
    x = splits.grouped_splits(_linked(spark, folder), table(spark, folder, "split_target"))
    return x.select(F.col("first").alias("first_record_id"), F.col("id").alias("record_id"), "split")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that must stay with a smaller one, from the groups that the splits were made of."""
    return p2_splits(spark, folder).filter("record_id <> first_record_id").select("first_record_id", "record_id").distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records and groups of every split against its target."""
    x = p2_splits(spark, folder)
    got = x.groupBy("split").agg(F.count("*").alias("records"), F.countDistinct("first_record_id").alias("groups"))
    return table(spark, folder, "split_target").join(got, "split", "left").na.fill(0, ["records", "groups"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The targets whose queue of priorities ends before what is required."""
    targets = table(spark, folder, "sample_target")
    queue = sampling.queues(table(spark, folder, "fewshot_pool"), "source_hash", FIELDS, targets)
    return sampling.shortages(queue, targets).filter("short").select("category_field", "category").distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every target with what it requires, what the pool has and what was drawn."""
    return sampling.sample_report(table(spark, folder, "fewshot_pool"), "source_hash", FIELDS, table(spark, folder, "sample_target"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn source_hash values of every field."""
    x = sampling.proportional_sample(table(spark, folder, "fewshot_pool"), "source_hash", FIELDS, table(spark, folder, "sample_target"))
    return x.select("category_field", "category", F.col("unit").alias("source_hash"), "priority", "floor")


def p5_joint_sample(spark: SparkSession, folder: str) -> DataFrame:
    """One sample that meets the targets of all fields together."""
    x = sampling.joint_sample(table(spark, folder, "fewshot_pool"), "source_hash", "record_id", FIELDS, table(spark, folder, "sample_target"))
    return x.withColumnsRenamed({"record": "record_id", "unit": "source_hash"})


def p5_joint_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every target with its share of the joint sample."""
    x = p5_joint_sample(spark, folder)
    long = x.select(F.explode(F.array(*[F.struct(F.lit(f).alias("category_field"), F.col(f).alias("c")) for f in FIELDS])).alias("p")).select("p.*")
    got = long.groupBy("category_field", "c").agg(F.count("*").alias("drawn"))
    t = table(spark, folder, "sample_target").withColumn("c", sampling.label("category"))
    y = t.join(got, ["category_field", "c"], "left").na.fill(0, ["drawn"])
    return y.select("category_field", "category", "target_share", "min_rows", "drawn", (F.col("drawn") / F.col("sample_size")).alias("share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_splits, p2_report, p5_found, p5_report, p5_sample, p5_joint_sample, p5_joint_report)}
_LABEL = r"regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '[_\-\s]+', '_', 'g')"
_SHORT = f"""SELECT t.category_field, t.category, greatest(CAST(floor(t.target_share * t.sample_size + 0.5 + 1e-9) AS BIGINT), t.min_rows) AS required, coalesce(n, 0) AS available
  FROM sample_target t LEFT JOIN (SELECT f, c, count(DISTINCT source_hash) AS n FROM (
    {" UNION ALL ".join(f"SELECT '{x}' AS f, {_LABEL.format(x)} AS c, source_hash FROM fewshot_pool" for x in FIELDS)}) GROUP BY 1, 2) p
  ON p.f = t.category_field AND p.c = {_LABEL.format("t.category")}"""
_KEYS = r"""SELECT record_id AS id, unnest([k for k in ['p' || nullif(regexp_replace(pmid, '\D+', '', 'g'), ''), 'm' || CAST(TRY_CAST(regexp_replace(matches_hash, '\s+', '', 'g') AS HUGEINT) AS VARCHAR)] if k is not null]) AS k FROM fewshot_pool"""
_QUEUES = f"""SELECT *, row_number() OVER (PARTITION BY category_field, c ORDER BY substr(md5(CAST(source_hash AS VARCHAR) || '|7'), 1, 15)) AS rank FROM (
  SELECT DISTINCT t.category_field, t.category, p.c, t.target_share, t.min_rows, t.sample_size, p.source_hash FROM (
    {" UNION ALL ".join(f"SELECT '{x}' AS f, {_LABEL.format(x)} AS c, source_hash FROM fewshot_pool WHERE source_hash IS NOT NULL" for x in FIELDS)}) p
  JOIN sample_target t ON p.f = t.category_field AND p.c = {_LABEL.format("t.category")})"""
_DRAWN = f"""SELECT * FROM (SELECT *, (rank - 0.5) / target_share AS priority, rank <= min_rows AS floor,
    row_number() OVER (PARTITION BY category_field ORDER BY (rank <= min_rows) DESC, (rank - 0.5) / target_share, c, source_hash) AS seat
  FROM ({_QUEUES}) WHERE rank <= sample_size) WHERE seat <= sample_size"""
ORACLE = {
    "p5_sample": f"SELECT category_field, category, source_hash, priority, floor FROM ({_DRAWN})",
    "p5_report": f"""SELECT s.category_field, s.category, t.target_share, CAST(floor(t.target_share * t.sample_size + 0.5 + 1e-9) AS BIGINT) AS quota,
      s.required, s.available, coalesce(d.n, 0) AS drawn, s.available < s.required AS short
      FROM ({_SHORT}) s JOIN sample_target t USING (category_field, category)
      LEFT JOIN (SELECT category_field, category, count(*) AS n FROM ({_DRAWN}) GROUP BY ALL) d USING (category_field, category)""",
    "p5_found": f"SELECT category_field, category FROM ({_SHORT}) WHERE available < required",
    "p2_found": f"""WITH RECURSIVE k AS ({_KEYS}), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b USING (k)),
      r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
      SELECT min(b) AS first_record_id, a AS record_id FROM r GROUP BY a HAVING min(b) <> a""",
}
