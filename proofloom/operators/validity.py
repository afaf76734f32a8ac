"""Calibration, consistency and agreement of scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def statement_scores(steps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean score and number of steps per statement (and run); null scores count as steps but not in the mean."""
    return steps.groupBy(*(keys or ["run_id", "stmt_hash"])).agg(F.avg("score").alias("our_score"), F.count("*").alias("n_evidence"))


def residuals(scores: DataFrame, statements: DataFrame) -> DataFrame:
    """Scored statements with a belief, and ``residual``: our score minus the belief."""
    x = scores.join(statements, "stmt_hash").filter("our_score is not null and belief is not null")
    return x.withColumn("residual", F.col("our_score") - F.col("belief"))


def calibration(r: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Mean absolute error, root mean square error and bias per key with at least ``least`` statements."""
    e = F.col("residual")
    x = r.groupBy(*keys).agg(F.count("*").alias("n_stmts"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    return x.filter(F.col("n_stmts") >= least)


def consistency(steps: DataFrame) -> DataFrame:
    """Mean and maximum, per run, of the population deviation of a statement's scores (two scores at least)."""
    x = steps.filter("score is not null").groupBy("run_id", "stmt_hash").agg(F.stddev_pop("score").alias("sd"), F.count("*").alias("n")).filter("n > 1")
    return x.groupBy("run_id").agg(F.count("*").alias("n_multi"), F.avg("sd").alias("mean_stdev"), F.max("sd").alias("max_stdev"))


def shares(steps: DataFrame, column: str = "verdict") -> DataFrame:
    """Rows and share of every value of ``column`` per run; null and empty values are unknown."""
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    x = steps.groupBy("run_id", label.alias(column)).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("run_id")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(x: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy per key; an undefined measure is 0. Null predictions or truths are left out."""
    y = x.withColumns({"__p": predicted, "__a": actual}).filter("__p is not null and __a is not null")
    c = y.groupBy(*keys).agg(*[F.count_if(t).alias(n) for n, t in (("tp", F.expr("__p and __a")), ("fp", F.expr("__p and not __a")), ("fn", F.expr("not __p and __a")), ("tn", F.expr("not __p and not __a")))])
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return c.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def supports_delta(scores: DataFrame, statements: DataFrame) -> DataFrame:
    """Difference of the mean scores of statements with and without supports, per run; NaN and a reason if one is missing."""
    x = scores.join(statements, "stmt_hash").filter("our_score is not null")
    a, b = F.avg(F.when(F.col("has_supports"), F.col("our_score"))), F.avg(F.when(~F.col("has_supports"), F.col("our_score")))
    y = x.groupBy("run_id").agg(a.alias("with_supports"), b.alias("without_supports"))
    delta = F.col("with_supports") - F.col("without_supports")
    return y.withColumn("delta", F.coalesce(delta, F.lit(float("nan")))).withColumn("unavailable_reason", F.when(delta.isNull(), "one bucket is empty"))


def metric_rows(frames: dict[str, tuple[DataFrame, dict[str, str], list[str]]]) -> DataFrame:
    """Metrics as (run_id, metric_name, slice_json, value): of every frame the named value columns, sliced by its keys."""
    out = []
    for prefix, (df, values, keys) in frames.items():
        pairs = F.explode(F.array(*[F.struct(F.lit(f"{prefix}.{n}").alias("metric_name"), F.col(c).cast("double").alias("value")) for c, n in values.items()])).alias("m")
        out.append(df.select("run_id", F.to_json(F.struct(*keys)).alias("slice_json") if keys else F.lit("{}").alias("slice_json"), pairs).select("run_id", "m.metric_name", "slice_json", "m.value"))
    return reduce(DataFrame.unionByName, out)


def verdict_lattice(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Statement verdict: incorrect if any step is, else abstain if any is, else correct if all are, else mixed or unknown."""
    n = {v: F.count_if(F.col("verdict") == v) for v in ("incorrect", "abstain", "correct")}
    v = F.when(n["incorrect"] > 0, "incorrect").when(n["abstain"] > 0, "abstain").when((n["correct"] > 0) & (n["correct"] == F.count("*")), "correct").when(n["correct"] > 0, "mixed").otherwise("unknown")
    return steps.groupBy(*keys).agg(v.alias("stmt_verdict"), F.count("*").alias("n_steps"))
