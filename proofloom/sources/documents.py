"""Sources of statement documents: JSON arrays, gzip files, JSON lines with a count of bad lines, and file discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def statement_array(spark: SparkSession, path: str) -> DataFrame:
    """(raw_json) of every statement of the JSON array files at ``path`` (.json or .json.gz), untouched but for spacing.

    Array files can't be split, so the rows are spread over the cluster right after reading. A file that is no JSON
    array gives no rows.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<variant>").alias("a"))
    return whole.select(F.explode("a").alias("v")).select(F.to_json("v").alias("raw_json")).repartition(spark.sparkContext.defaultParallelism)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the records of JSON lines files by ``schema``, and the lines that are not valid by it as (line)."""
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    x = spark.read.text(path).filter(F.trim("value") != "").withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return x.filter("r._bad is null").select("r.*").drop("_bad"), x.filter("r._bad is not null").select(F.col("value").alias("line"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified_at, kind) of the data files below a folder; contents are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.regexp_extract(F.lower("path"), r"\.(json|jsonl|parquet|csv|orc)(?:\.gz)?$", 1)
    return x.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), kind.alias("kind")).filter("kind <> ''")


def already_present(docs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys of ``docs`` there are, and how many ``known`` holds already."""
    x = docs.select(key).distinct().join(known.select(key).distinct().withColumn("__k", F.lit(1)), key, "left")
    return x.agg(F.count("*").alias("keys"), F.count("__k").alias("present"))


def lookup(index: DataFrame, claims: DataFrame) -> DataFrame:
    """The best index entry of each claim by source_hash: one whose agents hold all the claim's names, else the first.

    ``index`` has source_hash, position, agents (array) and any payload; ``claims`` has claim_id, source_hash, names
    (array). Claims without an entry have null payload.
    """
    x = claims.join(index, "source_hash", "left")
    miss = F.coalesce((F.size(F.array_except(F.col("names"), F.col("agents"))) > 0).cast("int"), F.lit(1))
    rest = [c for c in index.columns if c != "source_hash"]
    best = F.min_by(F.struct(*rest), F.struct(miss, "position"))
    return x.groupBy("claim_id", "source_hash").agg(best.alias("r")).select("claim_id", "source_hash", *[F.col(f"r.{c}").alias(c) for c in rest])
