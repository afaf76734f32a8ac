"""Two runs over the same evidences: overlap, agreement, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.operators.windows import latest

KEY = ["stmt_hash", "evidence_hash"]
_COLS = ["score", "verdict", "confidence", "latency_ms", "started_at", "step_hash", "error"]


def arm(steps: DataFrame, run_id: str, prefix: str) -> DataFrame:
    """The newest step of every pair in a run, its columns prefixed."""
    x = latest(steps.filter(F.col("run_id") == run_id).select("run_id", *KEY, *_COLS), ["run_id", *KEY])
    return x.select(*KEY, *[F.col(c).alias(f"{prefix}_{c}") for c in _COLS])


def overlap(steps: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """Pairs in both runs (or in either, with ``how`` full); each run is reduced to its newest steps first."""
    return arm(steps, a, "a").join(arm(steps, b, "b"), KEY, how)


def integrity(steps: DataFrame, a: str, b: str) -> DataFrame:
    """Per side: rows, distinct pairs, errors, repeated rows, pairs the other side lacks; and the common pairs."""
    side = F.when(F.col("run_id") == a, "a").when(F.col("run_id") == b, "b")
    bad = F.nullif(F.trim(F.coalesce("error", F.lit(""))), F.lit("")).isNotNull()
    x = steps.withColumn("side", side).filter("side is not null").groupBy(*KEY, "side").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    y = x.groupBy(*KEY).agg(F.collect_list(F.struct("side", "n", "bad")).alias("s")).select(F.size("s").alias("k"), F.explode("s").alias("s"))
    return y.groupBy(F.col("s.side").alias("side")).agg(
        F.sum("s.n").alias("rows"), F.count("*").alias("pairs"), F.sum("s.bad").alias("errors"), F.sum(F.col("s.n") - 1).alias("repeated"), F.count_if(F.col("k") == 1).alias("only_here"), F.count_if(F.col("k") == 2).alias("common")
    )


def comparison(pairs: DataFrame, belief: Column) -> DataFrame:
    """One row over the common pairs: agreement, support cells, error of both arms, differences."""
    ok_a, ok_b = F.col("a_verdict") == "correct", F.col("b_verdict") == "correct"
    ea, eb = F.col("a_score") - belief, F.col("b_score") - belief
    return pairs.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("a_verdict") == F.col("b_verdict")).alias("same_verdict"),
        F.count_if(ok_a == ok_b).alias("same_support"),
        F.count_if(ok_a & ok_b).alias("both_support"),
        F.count_if(ok_a & ~ok_b).alias("a_only"),
        F.count_if(~ok_a & ok_b).alias("b_only"),
        F.count_if(~ok_a & ~ok_b).alias("neither"),
        F.avg(F.abs(ea)).alias("a_mae"),
        F.avg(F.abs(eb)).alias("b_mae"),
        F.avg(ea).alias("a_bias"),
        F.avg(eb).alias("b_bias"),
        F.avg(F.col("b_score") - F.col("a_score")).alias("mean_change"),
        F.sum("a_latency_ms").alias("a_latency_ms"),
        F.sum("b_latency_ms").alias("b_latency_ms"),
    )


def movement(pairs: DataFrame) -> DataFrame:
    """The matrix of verdict pairs: rows, mean change of score, and whether support stayed, came or went."""
    was, now = F.col("a_verdict") == "correct", F.col("b_verdict") == "correct"
    cell = F.when(was & ~now, "lost").when(~was & now, "gained").otherwise("kept")
    return pairs.groupBy("a_verdict", "b_verdict", cell.alias("cell")).agg(F.count("*").alias("n"), F.avg(F.col("b_score") - F.col("a_score")).alias("mean_change"))


def exemplars(pairs: DataFrame, belief: Column, most: int = 8) -> DataFrame:
    """``most`` example pairs of each lane, the largest difference first: a_wins, b_wins, disagree, both_fail."""
    ea, eb = F.abs(F.col("a_score") - belief), F.abs(F.col("b_score") - belief)
    lanes = F.array_compact(F.array(F.when(ea < eb, "a_wins"), F.when(eb < ea, "b_wins"), F.when(F.col("a_verdict") != F.col("b_verdict"), "disagree"), F.when((ea >= 0.25) & (eb >= 0.25), "both_fail")))
    x = pairs.select(*KEY, F.round(F.abs(ea - eb), 9).alias("difference"), F.explode(lanes).alias("lane"))
    w = Window.partitionBy("lane").orderBy(F.desc("difference"), *KEY)
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def side_lanes(pairs: DataFrame, most: int = 8) -> DataFrame:
    """``most`` pairs of each lane that ``exemplars`` can't hold, the newest first: a_only, b_only, excluded.

    ``pairs`` is the full ``overlap``. A pair of both runs is excluded if a side failed or has no score; ``reason``
    tells which side and why, null for the other lanes.
    """
    bad = {x: F.nullif(F.trim(F.coalesce(f"{x}_error", F.lit(""))), F.lit("")).isNotNull() for x in "ab"}
    here = {x: F.col(f"{x}_step_hash").isNotNull() for x in "ab"}
    reason = F.concat_ws(
        ", ", *[F.when(bad[x], f"{x} failed").when(F.col(f"{x}_score").isNull(), f"{x} has no score") for x in "ab"]
    )
    lane = F.when(~here["b"], "a_only").when(~here["a"], "b_only").when(reason != "", "excluded")
    at = F.coalesce(F.greatest("a_started_at", "b_started_at"), "a_started_at", "b_started_at")
    x = pairs.select(*KEY, lane.alias("lane"), F.when(lane == "excluded", reason).alias("reason"), at.alias("at")).filter("lane is not null")
    w = Window.partitionBy("lane").orderBy(F.desc_nulls_last("at"), *KEY)
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("at")
