"""Latest, best and capped rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; ties must be broken by ``order``. Null keys are keys."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def latest(df: DataFrame, keys: list[str], at: str = "started_at", tie: str = "step_hash") -> DataFrame:
    """The newest row of each key; a row without a time is older than any other, of equal times the largest ``tie`` wins.

    Spark keeps one row a key and task before the shuffle, so a key that a third of all rows hold is cheap.
    """
    return first_by(df, keys, [F.desc_nulls_last(at), F.desc_nulls_last(tie)])


def gold(labels: DataFrame, steps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Steps with the label that applies to them: a label of the step's evidence, for its statement or for any.

    A label for the statement goes before a general one, a verdict before a tag, then the smaller value. Steps without
    a label have no row. The join keeps its equality on the evidence and tests the statement in its condition. The
    steps' columns ``carry`` are kept, so nothing has to be joined back to the steps.
    """
    on = (F.col("l.target_id") == F.col("s.evidence_hash")) & (F.col("l.relation_target_id").isNull() | (F.col("l.relation_target_id") == F.col("s.stmt_hash")))
    key = ["run_id", "stmt_hash", "evidence_hash", "step_hash"]
    x = steps.alias("s").join(labels.alias("l"), on).select(*[f"s.{c}" for c in key], "s.verdict", *[f"s.{c}" for c in carry], F.col("l.value_text").alias("gold"), F.col("l.field").alias("gold_field"), F.col("l.relation_target_id").isNull().alias("general"))
    return first_by(x, key, [F.col("general"), (F.col("gold_field") != "verdict"), F.asc_nulls_last("gold")]).drop("general")


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page of ``size`` rows with their ``row`` numbers and the ``total``; an offset past the end gives the last page."""
    total = df.count()
    last = max(0, (total - 1) // size * size) if total else 0
    start = min(max(0, offset) // size * size, last)
    rows = df.orderBy(*order).offset(start).limit(size)
    return rows.withColumn("row", F.row_number().over(Window.orderBy(*order)) + start).withColumn("total", F.lit(total).cast("bigint"))
