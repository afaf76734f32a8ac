"""The audit model (statements, memberships, scored steps, labels, runs) over the test tables, as DataFrames and as SQL.

statement       <- orders     stmt_hash, stmt_type (priority), belief (price / 500000, null for every 17th), has_supports
step            <- lineitem   aggregate steps of two runs (line status): score, verdict, confidence, cost columns
membership      <- lineitem   distinct (stmt_hash, evidence_hash); an evidence is shared by up to three statements
evidence        <- lineitem   distinct evidence_hash with its source_api
truth_label     <- lineitem   verdict and tag labels of the evidence, half of them for one statement only
trace_step      <- events     the step log with JSON output
run             <- supplier   runs with architecture, status and start
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.sources.tables import table

SOURCES = ["reach", "sparser", "medscan", "rlimsp", "trips", "signor", "biogrid", "biopax"]
KINDS = ["parse_claim", "build_context", "substrate_route", "subject_role_probe", "object_role_probe", "relation_axis_probe", "scope_probe", "grounding", "adjudicate", "aggregate", "aggregate"]

_EVIDENCE = "concat('e', cast(div(l_orderkey, 3) * 8 + l_linenumber as string))"
_VERDICT = "CASE l_returnflag WHEN 'N' THEN 'correct' WHEN 'A' THEN 'incorrect' ELSE 'abstain' END"


def statement(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) AS stmt_hash",
        "o_orderpriority AS stmt_type",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 500000.0D END AS belief",
        "o_orderstatus = 'P' AS has_supports",
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr("*", f"{_EVIDENCE} AS evidence_hash", "cast(l_orderkey as string) AS stmt_hash")


def step(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregate steps; score is null where l_linenumber = 7 and l_tax = 0."""
    return _lines(spark, folder).selectExpr(
        "concat('run_', l_linestatus) AS run_id",
        "stmt_hash",
        "evidence_hash",
        "CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL ELSE 1 - 10 * l_discount END AS score",
        f"{_VERDICT} AS verdict",
        "CASE WHEN l_tax < 0.03 THEN 'low' WHEN l_tax < 0.06 THEN 'medium' ELSE 'high' END AS confidence",
        "l_shipdate AS started_at",
        "concat_ws('|', l_linestatus, l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int), cast(round(l_extendedprice * 100) as bigint)) AS step_hash",
        "cast(l_quantity * 10 as int) AS latency_ms",
        "CASE WHEN l_quantity = 2 THEN -1 WHEN l_quantity = 3 THEN NULL ELSE cast(floor(l_extendedprice / 100) as int) END AS prompt_tokens",
        "l_linenumber AS out_tokens",
        "CASE WHEN l_quantity = 1 THEN 'timeout' WHEN l_quantity = 2 THEN ' ' END AS error",
    )


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    n = "cast(substr(evidence_hash, 2) as bigint)"
    names = ", ".join(f"'{s}'" for s in SOURCES)
    return _lines(spark, folder).select("evidence_hash").distinct().selectExpr("evidence_hash", f"element_at(array({names}), cast(({n} + div({n}, 8)) % 8 as int) + 1) AS source_api", f"{n} % 3 = 0 AS is_curated")


def membership(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("stmt_hash", "evidence_hash").distinct()


def truth_label(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _lines(spark, folder)
        .selectExpr(
            "evidence_hash AS target_id",
            "CASE WHEN l_suppkey % 2 = 0 THEN stmt_hash END AS relation_target_id",
            "CASE WHEN l_quantity < 25 THEN 'verdict' ELSE 'tag' END AS field",
            "CASE WHEN l_extendedprice < 30000 THEN 'correct' ELSE 'incorrect' END AS value_text",
        )
        .distinct()
    )


def run(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "concat('r', s_suppkey) AS run_id",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'decomposed' ELSE 'monolithic' END AS architecture",
        "CASE s_nationkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'succeeded' END AS status",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(s_suppkey as int)) AS started_at",
        "s_acctbal AS cost",
    )


def trace_step(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of five runs; ``output_json`` holds score, verdict and tier of aggregates, k of every step."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    x = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    x = x.withColumn("step_kind", F.expr(f"element_at(array({kinds}), cast((event_id * 7 + k) % 11 as int) + 1)"))
    aggregate = F.col("step_kind") == "aggregate"
    out = F.struct(
        "k",
        F.when(aggregate & (F.col("k") % 10 != 0), F.col("k") / 100).alias("score"),
        F.when(aggregate, F.expr("CASE WHEN k >= 60 THEN 'correct' WHEN k >= 30 THEN 'abstain' ELSE 'incorrect' END")).alias("verdict"),
        F.when(aggregate & (F.col("k") % 2 == 0), "t1").alias("tier"),
        F.when((F.col("event_type") == "error") & (F.col("k") < 3), "parse").alias("error"),
    )
    return x.select(
        F.concat(F.lit("r"), F.col("user_id") % 5).alias("run_id"),
        F.concat(F.lit("s"), "user_id").alias("stmt_hash"),
        F.concat(F.lit("v"), "user_id", F.lit("_"), F.col("event_id") % 2).alias("evidence_hash"),
        "step_kind",
        F.to_json(out).alias("output_json"),
        F.col("ts").alias("started_at"),
        F.concat(F.lit("h"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("step_hash"),
        F.when(F.col("value") > 1, F.floor("value").cast("int")).alias("latency_ms"),
        (F.col("k") % 4 == 0).alias("substrate"),
    )


def trace_output(c: Column | str = "output_json") -> Column:
    """The output of a trace step, parsed once."""
    return F.from_json(c, "k int, score double, verdict string, tier string, error string")


_E = "'e' || CAST((l_orderkey // 3) * 8 + l_linenumber AS VARCHAR)"
_L = f"(SELECT *, {_E} AS evidence_hash, CAST(l_orderkey AS VARCHAR) AS stmt_hash FROM lineitem)"
SQL = f"""WITH statement_v AS (SELECT CAST(o_orderkey AS VARCHAR) AS stmt_hash, o_orderpriority AS stmt_type,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 500000.0 END AS belief, o_orderstatus = 'P' AS has_supports FROM orders),
step_v AS (SELECT 'run_' || l_linestatus AS run_id, stmt_hash, evidence_hash,
  CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL ELSE 1 - 10 * l_discount END AS score, {_VERDICT} AS verdict,
  CASE WHEN l_tax < 0.03 THEN 'low' WHEN l_tax < 0.06 THEN 'medium' ELSE 'high' END AS confidence, l_shipdate AS started_at,
  concat_ws('|', l_linestatus, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS step_hash,
  CAST(l_quantity * 10 AS INT) AS latency_ms,
  CASE WHEN l_quantity = 2 THEN -1 WHEN l_quantity = 3 THEN NULL ELSE CAST(floor(l_extendedprice / 100) AS INT) END AS prompt_tokens,
  l_linenumber AS out_tokens, CASE WHEN l_quantity = 1 THEN 'timeout' WHEN l_quantity = 2 THEN ' ' END AS error FROM {_L}),
evidence_v AS (SELECT evidence_hash, ([{", ".join(f"'{s}'" for s in SOURCES)}])[(CAST(substr(evidence_hash, 2) AS BIGINT) + CAST(substr(evidence_hash, 2) AS BIGINT) // 8) % 8 + 1] AS source_api,
  CAST(substr(evidence_hash, 2) AS BIGINT) % 3 = 0 AS is_curated FROM (SELECT DISTINCT evidence_hash FROM {_L})),
membership_v AS (SELECT DISTINCT stmt_hash, evidence_hash FROM {_L}),
truth_label_v AS (SELECT DISTINCT evidence_hash AS target_id, CASE WHEN l_suppkey % 2 = 0 THEN stmt_hash END AS relation_target_id,
  CASE WHEN l_quantity < 25 THEN 'verdict' ELSE 'tag' END AS field, CASE WHEN l_extendedprice < 30000 THEN 'correct' ELSE 'incorrect' END AS value_text FROM {_L}),
run_v AS (SELECT 'r' || s_suppkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'decomposed' ELSE 'monolithic' END AS architecture,
  CASE s_nationkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'succeeded' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(s_suppkey AS INT)) AS started_at, s_acctbal AS cost FROM supplier),
trace_v AS (SELECT 'r' || (user_id % 5) AS run_id, 's' || user_id AS stmt_hash, 'v' || user_id || '_' || (event_id % 2) AS evidence_hash, step_kind,
  CASE WHEN step_kind = 'aggregate' AND k % 10 <> 0 THEN k / 100 END AS score,
  CASE WHEN step_kind = 'aggregate' THEN CASE WHEN k >= 60 THEN 'correct' WHEN k >= 30 THEN 'abstain' ELSE 'incorrect' END END AS verdict,
  CASE WHEN step_kind = 'aggregate' AND k % 2 = 0 THEN 't1' END AS tier, CASE WHEN event_type = 'error' AND k < 3 THEN 'parse' END AS error,
  k, ts AS started_at, 'h' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS step_hash, CASE WHEN value > 1 THEN CAST(floor(value) AS INT) END AS latency_ms, k % 4 = 0 AS substrate
  FROM (SELECT *, ([{", ".join(f"'{k}'" for k in KINDS)}])[(event_id * 7 + k) % 11 + 1] AS step_kind FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)))
"""
