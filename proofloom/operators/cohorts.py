"""Filtered cohorts of statements and scored evidences, with the reason when one is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.operators.windows import first_by

#: Rows that a cohort page shows.
COHORT_ROWS = 500
FLAGS = ("verdict_present", "score_present", "multi_evidence", "supports")
VALUES = ("source_api", "verdict", "confidence", "stmt_type")
PLANES = ("aggregate_only", "native_decomposed")


def checked(filters: dict[str, object]) -> dict[str, object]:
    """The active filters; an unknown name or an impossible value raises a ValueError naming it."""
    out: dict[str, object] = {}
    for k, v in filters.items():
        if v is None or v is False or v == "":
            continue
        if k in FLAGS:
            if str(v).lower() not in ("true", "1", "yes"):
                raise ValueError(f"{k}: not a flag: {v}")
            out[k] = True
        elif k in VALUES:
            out[k] = str(v)
        elif k == "trace_fidelity":
            if v not in PLANES:
                raise ValueError(f"{k}: one of {PLANES}")
            out[k] = v
        else:
            raise ValueError(f"unknown filter {k}")
    return out


def predicates(filters: dict[str, object]) -> dict[str, Column]:
    """A predicate per active filter over cohort rows; comparisons treat null as the empty text."""
    p: dict[str, Column] = {}
    for k, v in checked(filters).items():
        if k in VALUES:
            p[k] = F.coalesce(F.col(k), F.lit("")) == v
        elif k == "verdict_present":
            p[k] = F.col("verdict").isNotNull()
        elif k == "score_present":
            p[k] = F.col("score").isNotNull()
        elif k == "multi_evidence":
            p[k] = F.col("n_siblings") > 1
        elif k == "supports":
            p[k] = F.coalesce("has_supports", F.lit(False))
        else:
            p[k] = F.col("has_trace") if v == "native_decomposed" else ~F.col("has_trace")
    return p


def cohort_rows(steps: DataFrame, statements: DataFrame, evidence: DataFrame, trace: DataFrame | None = None) -> DataFrame:
    """Scored steps with what the filters need: statement and evidence columns, siblings, trace and residual.

    ``trace`` holds (run_id, evidence_hash) with steps other than aggregates; without it nothing is traced.
    """
    n = steps.groupBy("run_id", "stmt_hash").agg(F.count("*").alias("n_siblings"))
    x = steps.join(n, ["run_id", "stmt_hash"]).join(statements, "stmt_hash").join(evidence, "evidence_hash", "left")
    if trace is None:
        x = x.withColumn("has_trace", F.lit(False))
    else:
        x = x.join(trace.select("run_id", "evidence_hash").distinct().withColumn("has_trace", F.lit(True)), ["run_id", "evidence_hash"], "left").na.fill(False, ["has_trace"])
    return x.withColumn("residual", F.col("score") - F.col("belief"))


def evidence_cohort(rows: DataFrame, run_id: str, filters: dict[str, object], limit: int = COHORT_ROWS) -> DataFrame:
    """The run's rows that pass all filters, largest residual first, ``limit`` at most: a top-k report."""
    keep = reduce(lambda a, b: a & b, predicates(filters).values(), F.col("run_id") == run_id)
    return rows.filter(keep).orderBy(F.desc_nulls_last(F.abs("residual")), "stmt_hash", "evidence_hash", "step_hash").limit(limit)


def statement_cohort(rows: DataFrame, run_id: str, filters: dict[str, object], limit: int = COHORT_ROWS) -> DataFrame:
    """Statements with a row that passes all filters, with their mean score and a representative evidence.

    The representative is a passing row, the one with the largest residual first.
    """
    hit = reduce(lambda a, b: a & b, predicates(filters).values(), F.lit(True))
    x = rows.filter(F.col("run_id") == run_id).withColumn("hit", F.coalesce(hit, F.lit(False)))
    agg = x.groupBy("stmt_hash", "stmt_type", "belief").agg(F.avg("score").alias("our_score"), F.count("*").alias("n_evidence"), F.max("hit").alias("any_hit")).filter("any_hit")
    rep = first_by(x, ["stmt_hash"], [F.desc("hit"), F.desc_nulls_last(F.abs("residual")), F.col("evidence_hash"), F.col("step_hash")]).select("stmt_hash", F.col("evidence_hash").alias("representative"))
    y = agg.join(rep, "stmt_hash").withColumn("residual", F.col("our_score") - F.col("belief")).drop("any_hit")
    return y.orderBy(F.desc_nulls_last(F.abs(F.round("residual", 9))), "stmt_hash").limit(limit)


def diagnostics(rows: DataFrame, run_id: str, filters: dict[str, object]) -> DataFrame:
    """One row per active filter: how many of the run's rows pass it, pass all filters, and why the cohort is empty.

    One pass over the run: an empty run is empty_run, a filter that no row passes absent_in_run, filters that no row
    passes together no_intersection; otherwise the reason is null.
    """
    p = predicates(filters)
    both = reduce(lambda a, b: a & b, p.values(), F.lit(True))
    counts = [F.count_if(c).alias(k) for k, c in p.items()]
    x = rows.filter(F.col("run_id") == run_id).agg(F.count("*").alias("__run"), F.count_if(both).alias("__all"), *counts)
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("filter"), F.col(k).alias("passing")) for k in p] or [F.struct(F.lit("none").alias("filter"), F.col("__run").alias("passing"))])).alias("i")
    reason = F.when(F.col("__run") == 0, "empty_run").when(F.col("passing") == 0, "absent_in_run").when(F.col("__all") == 0, "no_intersection")
    return x.select("__run", "__all", items).select(F.col("i.filter").alias("filter"), F.col("i.passing").alias("passing"), "__run", "__all").select("filter", "passing", F.col("__run").alias("run_rows"), F.col("__all").alias("matching"), reason.alias("reason"))
