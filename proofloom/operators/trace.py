"""How completely a run recorded the steps of each scored evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = ("subject_role_probe", "object_role_probe", "relation_axis_probe", "scope_probe")
#: Steps of a complete decomposed trace.
EXPECTED = ("parse_claim", "build_context", "substrate_route", *PROBES, "grounding", "adjudicate")


def snapshot(steps: DataFrame, at: Column | None) -> DataFrame:
    """The steps started no later than ``at``; all of them without one."""
    return steps if at is None else steps.filter(F.col("started_at") <= at)


def trace_states(steps: DataFrame, status: Column) -> DataFrame:
    """One row per (run_id, stmt_hash, evidence_hash): what was captured, what is missing, and the trace state.

    ``steps`` has step_kind, step_hash, started_at, latency_ms, score, verdict and error (null if none). The state is
    the first that holds: step_error; without an aggregate missing_aggregate for a succeeded run and
    terminated_inflight for others; aggregate_only without other steps; full with all EXPECTED; partial. The
    representative step is an erroneous one, else an aggregate, the newest. Everything is one partial aggregation.
    """
    bad, aggregate = F.col("error").isNotNull(), F.col("step_kind") == "aggregate"
    rank = F.struct(F.when(bad, 2).when(aggregate, 1).otherwise(0).alias("r"), "started_at", "step_hash")
    x = steps.withColumn("status", status).groupBy("run_id", "stmt_hash", "evidence_hash").agg(
        F.max("status").alias("status"),
        F.max("started_at").alias("latest_at"),
        F.max_by("step_hash", rank).alias("representative"),
        F.count_if(aggregate).alias("n_aggregate"),
        F.count_if(~aggregate).alias("n_other"),
        F.count_if(bad).alias("n_errors"),
        F.array_sort(F.collect_set("step_kind")).alias("captured"),
        F.max(F.when(aggregate, F.col("score"))).alias("score"),
        F.sum("latency_ms").alias("latency_ms"),
    )
    x = x.withColumn("missing", F.array_except(F.array(*map(F.lit, EXPECTED)), "captured"))
    state = (
        F.when(F.col("n_errors") > 0, "step_error")
        .when((F.col("n_aggregate") == 0) & (F.col("status") == "succeeded"), "missing_aggregate")
        .when(F.col("n_aggregate") == 0, "terminated_inflight")
        .when(F.col("n_other") == 0, "aggregate_only")
        .when(F.size("missing") == 0, "full")
        .otherwise("partial")
    )
    return x.withColumn("trace_state", state)


def trace_summary(states: DataFrame) -> DataFrame:
    """Evidences, mean steps missing and total latency per run and state."""
    return states.groupBy("run_id", "trace_state").agg(F.count("*").alias("n"), F.avg(F.size("missing")).alias("mean_missing"), F.sum("latency_ms").alias("latency_ms"))


def probe_coverage(steps: DataFrame) -> DataFrame:
    """Per run and probe, over all its evidences: answered by rule, by model, or not run."""
    total = steps.groupBy("run_id").agg(F.countDistinct("stmt_hash", "evidence_hash").alias("total"))
    per = steps.filter(F.col("step_kind").isin(*PROBES)).groupBy("run_id", "stmt_hash", "evidence_hash", F.col("step_kind").alias("probe")).agg(F.max("substrate").alias("rule"))
    x = per.groupBy("run_id", "probe").agg(F.count_if("rule").alias("by_rule"), F.count_if(~F.col("rule")).alias("by_model"))
    grid = total.select("run_id", "total", F.explode(F.array(*map(F.lit, PROBES))).alias("probe"))
    y = grid.join(x, ["run_id", "probe"], "left").na.fill(0, ["by_rule", "by_model"])
    return y.withColumn("not_run", F.col("total") - F.col("by_rule") - F.col("by_model")).drop("total")


def clamped(steps: DataFrame, requested: str | None) -> DataFrame:
    """One row ``at``: the time requested, or the newest step's where none or a later one is asked for."""
    newest = F.max("started_at")
    asked = F.lit(requested).cast("timestamp_ntz")
    return steps.agg(F.coalesce(F.least(asked, newest.cast("timestamp_ntz")), newest.cast("timestamp_ntz")).alias("at"))
