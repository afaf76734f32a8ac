"""Sinks: upserts, append-only logs, replaced runs and exports, on plain Parquet and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; null keys are equal to each other.

    Of several new rows of one key the one with the largest ``order`` stays (by all columns, without ``order``).
    """
    cols = old.columns
    by = F.struct(*([order] if order else []), *[c for c in cols if c not in key and c != order]) if len(cols) > len(key) else F.lit(1)
    last = new.groupBy(*key).agg(F.max_by(F.struct(*cols), by).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in cols])
    on = None
    for c in key:
        eq = F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        on = eq if on is None else on & eq
    return old.alias("o").join(last.select(*key).alias("n"), on, "left_anti").unionByName(last)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a data file lies below ``path``. A path that is not there has none; any other failure is raised."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return False
    files = fs.listFiles(where, True)
    while files.hasNext():
        f = files.next().getPath()
        if f.getName()[0] not in "_." and "/_temporary/" not in f.toString():
            return True
    return False


def append_log(new: DataFrame, path: str, key: str = "step_hash", partition: str = "run_id") -> int:
    """Append the rows whose key the log does not hold; returns how many. Running it again appends nothing."""
    spark = new.sparkSession
    fresh = new.dropDuplicates([key])
    if has_rows(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    count = Observation()
    fresh.observe(count, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(partition).parquet(path)
    return count.get["n"]


def replace_runs(metrics: DataFrame, path: str) -> None:
    """Write metrics partitioned by run_id, replacing the runs that ``metrics`` holds and no others."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def export_statements(statements: DataFrame, beliefs: DataFrame, path: str, only_scored: bool = False) -> None:
    """JSON lines of the documents with ``belief`` replaced by the computed one where there is one, ordered by key.

    ``statements`` has stmt_hash and raw_json, ``beliefs`` stmt_hash and belief. With ``only_scored`` statements
    without a computed belief are left out, unless there is none at all.
    """
    x = statements.join(beliefs, "stmt_hash", "left" if not only_scored or beliefs.isEmpty() else "inner")
    fields = F.from_json("raw_json", "map<string,variant>")
    new = F.map_concat(F.map_filter(fields, lambda k, _: k != "belief"), F.create_map(F.lit("belief"), F.parse_json(F.col("belief").cast("string"))))
    doc = F.when(F.col("belief").isNotNull(), F.to_json(new)).otherwise(F.col("raw_json"))
    x.select("stmt_hash", doc.alias("value")).orderBy("stmt_hash").select("value").write.mode("overwrite").text(path)


def model_card(run_id: str, metrics: DataFrame, ledger: DataFrame) -> dict:
    """A run's metrics and denominators as a dictionary; both are small tables by design. NaN becomes None."""
    m = {f"{r['metric_name']}{'' if r['slice_json'] in (None, '{}') else r['slice_json']}": None if r["value"] is None or r["value"] != r["value"] else r["value"] for r in metrics.filter(F.col("run_id") == run_id).collect()}
    d = {f"{r['family']}.{r['kind']}": r["value"] for r in ledger.filter(F.col("run_id").isNull() | (F.col("run_id") == run_id)).collect()}
    return {"run_id": run_id, "metrics": m, "denominators": d}


def read_log(spark: SparkSession, path: str, key: str = "step_hash", at: str = "started_at") -> DataFrame:
    """The log with one row per key, the newest."""
    x = spark.read.parquet(path)
    rest = [c for c in x.columns if c != key]
    return x.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
