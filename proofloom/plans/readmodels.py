"""Queries of cohorts, traces, paired runs, evaluation, ingest, scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.functions import scalars, textrules
from proofloom.operators import cohorts, evaluation, ingest, paired, trace, validity, windows
from proofloom.plans import audit
from proofloom.plans import views as V
from proofloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a query under its function's name, with its SQL, after the views if it uses them."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (V.SQL if views else "") + sql
        return f

    return put


rounded = audit.rounded


def _rows(s: SparkSession, d: str) -> DataFrame:
    other = V.trace_step(s, d).filter("step_kind <> 'aggregate'").select(F.concat(F.lit("run_"), F.when(F.col("run_id") == "r0", "O").otherwise("F")).alias("run_id"), F.concat(F.lit("e"), F.substring("stmt_hash", 2, 20)).alias("evidence_hash"))
    return cohorts.cohort_rows(V.step(s, d), V.statement(s, d), V.evidence(s, d), other)


_ROWS = """, tr AS (SELECT DISTINCT 'run_' || CASE WHEN run_id = 'r0' THEN 'O' ELSE 'F' END AS run_id, 'e' || substr(stmt_hash, 2) AS evidence_hash FROM trace_v WHERE step_kind <> 'aggregate'),
  cr AS (SELECT s.*, stmt_type, belief, has_supports, source_api, is_curated, count(*) OVER (PARTITION BY s.run_id, s.stmt_hash) AS n_siblings, tr.run_id IS NOT NULL AS has_trace, score - belief AS residual
  FROM step_v s JOIN statement_v USING (stmt_hash) LEFT JOIN evidence_v e USING (evidence_hash) LEFT JOIN tr ON tr.run_id = s.run_id AND tr.evidence_hash = s.evidence_hash) """
_F = {"source_api": "reach", "verdict": "correct", "score_present": True, "multi_evidence": True}
_FS = "run_id = 'run_O' AND source_api = 'reach' AND verdict = 'correct' AND score IS NOT NULL AND n_siblings > 1"


@query(_ROWS + f"SELECT stmt_hash, evidence_hash, step_hash, round(residual, 9) AS residual FROM cr WHERE {_FS} ORDER BY abs(residual) DESC NULLS LAST, stmt_hash, evidence_hash, step_hash LIMIT 500")
def t5_evidence_cohort(s, d):
    x = cohorts.evidence_cohort(_rows(s, d), "run_O", _F)
    return x.select("stmt_hash", "evidence_hash", "step_hash", F.round("residual", 9).alias("residual"))


@query(_ROWS + """SELECT stmt_hash, evidence_hash, step_hash FROM cr WHERE run_id = 'run_F' AND has_trace AND confidence = 'high' ORDER BY abs(residual) DESC NULLS LAST, stmt_hash, evidence_hash, step_hash LIMIT 500""")
def f3_trace_fidelity(s, d):
    x = cohorts.evidence_cohort(_rows(s, d), "run_F", {"trace_fidelity": "native_decomposed", "confidence": "high"})
    return x.select("stmt_hash", "evidence_hash", "step_hash")


@query(_ROWS + f""", a AS (SELECT stmt_hash, stmt_type, belief, avg(score) AS our_score, count(*) AS n_evidence FROM cr WHERE run_id = 'run_O' GROUP BY 1, 2, 3 HAVING bool_or({_FS})),
  r AS (SELECT stmt_hash, evidence_hash AS representative FROM cr WHERE run_id = 'run_O' QUALIFY row_number() OVER (PARTITION BY stmt_hash ORDER BY ({_FS}) DESC, abs(residual) DESC NULLS LAST, evidence_hash, step_hash) = 1)
  SELECT stmt_hash, stmt_type, round(belief, 6) AS belief, round(our_score, 6) AS our_score, n_evidence, representative FROM a JOIN r USING (stmt_hash) ORDER BY abs(round(our_score - belief, 9)) DESC NULLS LAST, stmt_hash LIMIT 500""")
def t4_statement_cohort(s, d):
    x = cohorts.statement_cohort(_rows(s, d), "run_O", _F)
    return rounded(x.select("stmt_hash", "stmt_type", "belief", "our_score", "n_evidence", "representative"))


@query(_ROWS + """, c AS (SELECT count(*) AS run_rows, count(*) FILTER (verdict = 'correct' AND stmt_type = 'none' AND score IS NOT NULL) AS matching, count(*) FILTER (verdict = 'correct') AS a, count(*) FILTER (stmt_type = 'none') AS b, count(*) FILTER (score IS NOT NULL) AS c FROM cr WHERE run_id = 'run_O')
  SELECT filter, passing, run_rows, matching, CASE WHEN run_rows = 0 THEN 'empty_run' WHEN passing = 0 THEN 'absent_in_run' WHEN matching = 0 THEN 'no_intersection' END AS reason FROM
  (SELECT 'verdict' AS filter, a AS passing, run_rows, matching FROM c UNION ALL SELECT 'stmt_type', b, run_rows, matching FROM c UNION ALL SELECT 'score_present', c, run_rows, matching FROM c)""")
def f8_diagnostics(s, d):
    return cohorts.diagnostics(_rows(s, d), "run_O", {"verdict": "correct", "stmt_type": "none", "score_present": True})


@query("SELECT run_id, count(*) AS steps, count(*) FILTER (step_kind = 'aggregate') AS aggregates, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (substrate) AS by_rule, count(DISTINCT evidence_hash) AS evidences FROM trace_v GROUP BY 1")
def f10_run_counts(s, d):
    x = V.trace_step(s, d).withColumn("error", V.trace_output()["error"])
    return x.groupBy("run_id").agg(F.count("*").alias("steps"), F.count_if(F.col("step_kind") == "aggregate").alias("aggregates"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("substrate").alias("by_rule"), F.countDistinct("evidence_hash").alias("evidences"))


@query("SELECT step_hash, score, verdict, tier, error FROM trace_v WHERE step_kind = 'aggregate'")
def f1_json_projection(s, d):
    x = V.trace_step(s, d).filter("step_kind = 'aggregate'").withColumn("o", V.trace_output())
    return x.select("step_hash", "o.score", "o.verdict", "o.tier", "o.error")


@query("SELECT run_id, count(*) AS n, count(*) FILTER (nullif(trim(coalesce(error, '')), '') IS NOT NULL) AS bad FROM step_v GROUP BY 1")
def f12_error_predicate(s, d):
    return V.step(s, d).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.nullif(F.trim(F.coalesce("error", F.lit(""))), F.lit("")).isNotNull()).alias("bad"))


def _trace(s: SparkSession, d: str) -> DataFrame:
    x = V.trace_step(s, d).withColumn("o", V.trace_output())
    return x.select("run_id", "stmt_hash", "evidence_hash", "step_kind", "step_hash", "started_at", "latency_ms", "substrate", "o.score", "o.verdict", "o.error")


def _status() -> Column:
    return F.when(F.col("run_id") == "r1", "running").otherwise("succeeded")


_STATE = """, te AS (SELECT run_id, stmt_hash, evidence_hash, max(started_at) AS latest_at, count(*) FILTER (step_kind = 'aggregate') AS n_aggregate, count(*) FILTER (step_kind <> 'aggregate') AS n_other, count(error) AS n_errors,
  count(DISTINCT step_kind) FILTER (step_kind <> 'aggregate') AS kinds, max(score) AS score, CAST(sum(latency_ms) AS BIGINT) AS latency_ms,
  arg_max(step_hash, (CASE WHEN error IS NOT NULL THEN 2 WHEN step_kind = 'aggregate' THEN 1 ELSE 0 END, started_at, step_hash)) AS representative FROM trace_v {where} GROUP BY 1, 2, 3),
  ts AS (SELECT *, CASE WHEN n_errors > 0 THEN 'step_error' WHEN n_aggregate = 0 AND run_id <> 'r1' THEN 'missing_aggregate' WHEN n_aggregate = 0 THEN 'terminated_inflight' WHEN n_other = 0 THEN 'aggregate_only' WHEN kinds = 9 THEN 'full' ELSE 'partial' END AS trace_state FROM te) """


@query(_STATE.format(where="") + "SELECT run_id, stmt_hash, evidence_hash, latest_at, representative, n_aggregate, n_errors, 9 - kinds AS n_missing, score, latency_ms, trace_state FROM ts")
def t2_trace_states(s, d):
    x = trace.trace_states(_trace(s, d), _status())
    return x.select("run_id", "stmt_hash", "evidence_hash", "latest_at", "representative", "n_aggregate", "n_errors", F.size("missing").cast("bigint").alias("n_missing"), "score", "latency_ms", "trace_state")


@query(_STATE.format(where="") + "SELECT run_id, trace_state, count(*) AS n, round(avg(9 - kinds), 6) AS mean_missing, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM ts GROUP BY 1, 2")
def t3_trace_summary(s, d):
    return rounded(trace.trace_summary(trace.trace_states(_trace(s, d), _status())))


@query(_STATE.format(where="WHERE started_at <= (SELECT min(started_at) + (max(started_at) - min(started_at)) / 2 FROM trace_v)") + "SELECT run_id, trace_state, count(*) AS n FROM ts GROUP BY 1, 2")
def t6_trace_snapshot(s, d):
    t = _trace(s, d)
    ends = t.select(F.unix_micros(F.min("started_at").cast("timestamp")).alias("a"), F.unix_micros(F.max("started_at").cast("timestamp")).alias("b"))
    at = ends.select(F.timestamp_micros((F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)).cast("bigint")).cast("timestamp_ntz")).first()[0]
    return trace.trace_states(trace.snapshot(t, F.lit(at)), _status()).groupBy("run_id", "trace_state").agg(F.count("*").alias("n"))


@query(""", n AS (SELECT run_id, count(DISTINCT (stmt_hash, evidence_hash)) AS total FROM trace_v GROUP BY 1), g AS (SELECT run_id, total, unnest(['subject_role_probe', 'object_role_probe', 'relation_axis_probe', 'scope_probe']) AS probe FROM n),
  p AS (SELECT run_id, stmt_hash, evidence_hash, step_kind AS probe, bool_or(substrate) AS rule FROM trace_v GROUP BY 1, 2, 3, 4), c AS (SELECT run_id, probe, count(*) FILTER (rule) AS by_rule, count(*) FILTER (NOT rule) AS by_model FROM p GROUP BY 1, 2)
  SELECT g.run_id, g.probe, coalesce(by_rule, 0) AS by_rule, coalesce(by_model, 0) AS by_model, total - coalesce(by_rule, 0) - coalesce(by_model, 0) AS not_run FROM g LEFT JOIN c ON c.run_id = g.run_id AND c.probe = g.probe""")
def t7_probe_coverage(s, d):
    return trace.probe_coverage(_trace(s, d))


@query(""", l AS (SELECT DISTINCT target_id, relation_target_id, field, value_text FROM truth_label_v), k AS (SELECT l.*,
  EXISTS (SELECT 1 FROM step_v s WHERE s.run_id = 'run_O' AND s.evidence_hash = l.target_id AND (l.relation_target_id IS NULL OR s.stmt_hash = l.relation_target_id)) AS ok,
  EXISTS (SELECT 1 FROM step_v s WHERE s.run_id = 'run_O' AND s.evidence_hash = l.target_id) AS scored, EXISTS (SELECT 1 FROM membership_v m WHERE m.evidence_hash = l.target_id) AS known FROM l)
  SELECT field, CASE WHEN ok THEN 'compared' WHEN scored THEN 'context_mismatch' WHEN known THEN 'not_scored' ELSE 'not_in_corpus' END AS status, count(*) AS n FROM k GROUP BY 1, 2""")
def t10_label_overlap(s, d):
    scored = V.step(s, d).filter("run_id = 'run_O'").select(F.col("evidence_hash").alias("target_id"), "stmt_hash").distinct()
    some = scored.groupBy("target_id").agg(F.count("*").alias("k"))
    known = V.membership(s, d).select(F.col("evidence_hash").alias("target_id")).distinct().withColumn("known", F.lit(True))
    exact = scored.withColumn("ok", F.lit(True)).withColumnRenamed("stmt_hash", "relation_target_id")
    x = V.truth_label(s, d).join(some, "target_id", "left").join(exact, ["target_id", "relation_target_id"], "left").join(known, "target_id", "left")
    ok = F.col("ok").isNotNull() | (F.col("relation_target_id").isNull() & F.col("k").isNotNull())
    status = F.when(ok, "compared").when(F.col("k").isNotNull(), "context_mismatch").when(F.col("known"), "not_scored").otherwise("not_in_corpus")
    return x.groupBy("field", status.alias("status")).agg(F.count("*").alias("n"))


@query(", e AS (SELECT stmt_hash, string_agg(DISTINCT source_api, ', ' ORDER BY source_api) AS sources, bool_or(is_curated) AS curated, count(*) AS n_evidence FROM membership_v JOIN evidence_v USING (evidence_hash) GROUP BY 1), sc AS (SELECT stmt_hash, avg(score) AS our_score FROM step_v WHERE run_id = 'run_O' GROUP BY 1) SELECT stmt_hash, stmt_type, belief, round(our_score, 6) AS our_score, sources, curated, n_evidence FROM statement_v JOIN e USING (stmt_hash) LEFT JOIN sc USING (stmt_hash)")
def t11_statement_matrix(s, d):
    e = V.membership(s, d).join(V.evidence(s, d), "evidence_hash").groupBy("stmt_hash").agg(F.array_join(F.array_sort(F.collect_set("source_api")), ", ").alias("sources"), F.max("is_curated").alias("curated"), F.count("*").alias("n_evidence"))
    sc = V.step(s, d).filter("run_id = 'run_O'").groupBy("stmt_hash").agg(F.round(F.avg("score"), 6).alias("our_score"))
    return V.statement(s, d).drop("has_supports").join(e, "stmt_hash").join(sc, "stmt_hash", "left")


_RES = f", {audit._SCORES} "


@query(_RES + "SELECT run_id, stmt_hash, round(residual, 9) AS residual FROM res QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY abs(round(residual, 9)) DESC, stmt_hash) <= 5")
def t15_biggest_disagreements(s, d):
    x = audit._res(s, d).withColumn("residual", F.round("residual", 9))
    w = Window.partitionBy("run_id").orderBy(F.desc(F.abs("residual")), "stmt_hash")
    return x.select("run_id", "stmt_hash", "residual", F.row_number().over(w).alias("r")).filter("r <= 5").drop("r")


@query(f""", v AS (SELECT run_id, stmt_hash, {audit._LATTICE} FROM step_v GROUP BY 1, 2) SELECT a.stmt_hash, a.stmt_verdict AS before, b.stmt_verdict AS after, CASE WHEN a.stmt_verdict = 'correct' THEN 'regression' WHEN b.stmt_verdict = 'correct' THEN 'recovery' ELSE 'move' END AS kind FROM v a JOIN v b ON a.stmt_hash = b.stmt_hash AND a.run_id = 'run_F' AND b.run_id = 'run_O' WHERE a.stmt_verdict <> b.stmt_verdict""")
def t16_run_diff(s, d):
    v = validity.verdict_lattice(V.step(s, d), ["run_id", "stmt_hash"])
    a = v.filter("run_id = 'run_F'").select("stmt_hash", F.col("stmt_verdict").alias("before"))
    b = v.filter("run_id = 'run_O'").select("stmt_hash", F.col("stmt_verdict").alias("after"))
    kind = F.when(F.col("before") == "correct", "regression").when(F.col("after") == "correct", "recovery").otherwise("move")
    return a.join(b, "stmt_hash").filter("before <> after").withColumn("kind", kind)


@query(_RES + ", b AS (SELECT unnest(['run_F', 'run_O']) AS run_id), g AS (SELECT run_id, unnest(range(11)) AS bin FROM b), h AS (SELECT run_id, CAST(least(10, floor(round((greatest(-1, least(1, residual)) + 1) * 5.5, 9))) AS INT) AS bin, count(*) AS n FROM res GROUP BY 1, 2) SELECT g.run_id, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN h ON h.run_id = g.run_id AND h.bin = g.bin")
def t17_residual_histogram(s, d):
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("residual")))
    bin_ = F.least(F.lit(10), F.floor(F.round((clamped + 1) * 5.5, 9))).cast("bigint")
    h = audit._res(s, d).groupBy("run_id", bin_.alias("bin")).agg(F.count("*").alias("n"))
    grid = V.step(s, d).select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(10).cast("bigint"))).alias("bin"))
    return grid.join(h, ["run_id", "bin"], "left").na.fill(0, ["n"])


_PAIR = f", {audit._LATEST}, pr AS (SELECT a.stmt_hash, a.evidence_hash, a.score AS a_score, b.score AS b_score, a.verdict AS a_verdict, b.verdict AS b_verdict, a.latency_ms AS a_latency_ms, b.latency_ms AS b_latency_ms FROM latest a JOIN latest b ON a.stmt_hash = b.stmt_hash AND a.evidence_hash = b.evidence_hash AND a.run_id = 'run_F' AND b.run_id = 'run_O') "


@query(_PAIR + "SELECT stmt_hash, evidence_hash, a_score, b_score, a_verdict, b_verdict FROM pr")
def j8_paired_overlap(s, d):
    return paired.overlap(V.step(s, d), "run_F", "run_O").select("stmt_hash", "evidence_hash", "a_score", "b_score", "a_verdict", "b_verdict")


@query(_PAIR + "SELECT stmt_hash, evidence_hash FROM latest l WHERE run_id = 'run_F' AND NOT EXISTS (SELECT 1 FROM latest o WHERE o.run_id = 'run_O' AND o.stmt_hash = l.stmt_hash AND o.evidence_hash = l.evidence_hash)")
def j9_left_only(s, d):
    st = V.step(s, d)
    return paired.arm(st, "run_F", "a").join(paired.arm(st, "run_O", "b"), paired.KEY, "left_anti").select(*paired.KEY)


@query(""", x AS (SELECT run_id, stmt_hash, evidence_hash, count(*) AS n, count(*) FILTER (nullif(trim(coalesce(error, '')), '') IS NOT NULL) AS bad, count(*) OVER (PARTITION BY stmt_hash, evidence_hash) AS k FROM step_v GROUP BY 1, 2, 3)
  SELECT CASE run_id WHEN 'run_F' THEN 'a' ELSE 'b' END AS side, CAST(sum(n) AS BIGINT) AS rows, count(*) AS pairs, CAST(sum(bad) AS BIGINT) AS errors, CAST(sum(n - 1) AS BIGINT) AS repeated, count(*) FILTER (k = 1) AS only_here, count(*) FILTER (k = 2) AS common FROM x GROUP BY 1""")
def t18_paired_integrity(s, d):
    return paired.integrity(V.step(s, d), "run_F", "run_O")


@query(_PAIR + """SELECT count(*) AS n, count(*) FILTER (a_verdict = b_verdict) AS same_verdict, count(*) FILTER ((a_verdict = 'correct') = (b_verdict = 'correct')) AS same_support, count(*) FILTER (a_verdict = 'correct' AND b_verdict = 'correct') AS both_support,
  count(*) FILTER (a_verdict = 'correct' AND b_verdict <> 'correct') AS a_only, count(*) FILTER (a_verdict <> 'correct' AND b_verdict = 'correct') AS b_only, count(*) FILTER (a_verdict <> 'correct' AND b_verdict <> 'correct') AS neither,
  round(avg(abs(a_score - belief)), 6) AS a_mae, round(avg(abs(b_score - belief)), 6) AS b_mae, round(avg(a_score - belief), 6) AS a_bias, round(avg(b_score - belief), 6) AS b_bias, round(avg(b_score - a_score), 6) AS mean_change,
  CAST(sum(a_latency_ms) AS BIGINT) AS a_latency_ms, CAST(sum(b_latency_ms) AS BIGINT) AS b_latency_ms FROM pr JOIN statement_v USING (stmt_hash)""")
def t19_paired_comparison(s, d):
    x = paired.overlap(V.step(s, d), "run_F", "run_O").join(V.statement(s, d), "stmt_hash")
    return rounded(paired.comparison(x, F.col("belief")))


@query(_PAIR + "SELECT a_verdict, b_verdict, CASE WHEN a_verdict = 'correct' AND b_verdict <> 'correct' THEN 'lost' WHEN a_verdict <> 'correct' AND b_verdict = 'correct' THEN 'gained' ELSE 'kept' END AS cell, count(*) AS n, round(avg(b_score - a_score), 6) AS mean_change FROM pr GROUP BY 1, 2, 3")
def t20_verdict_matrix(s, d):
    return rounded(paired.movement(paired.overlap(V.step(s, d), "run_F", "run_O")))


@query(_PAIR + """, e AS (SELECT *, abs(a_score - belief) AS ea, abs(b_score - belief) AS eb FROM pr JOIN statement_v USING (stmt_hash)),
  l AS (SELECT *, unnest([x for x in [CASE WHEN ea < eb THEN 'a_wins' END, CASE WHEN eb < ea THEN 'b_wins' END, CASE WHEN a_verdict <> b_verdict THEN 'disagree' END, CASE WHEN ea >= 0.25 AND eb >= 0.25 THEN 'both_fail' END] if x is not null]) AS lane FROM e)
  SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY round(abs(ea - eb), 9) DESC, stmt_hash, evidence_hash) AS rank, stmt_hash, evidence_hash FROM l WHERE round(abs(ea - eb), 9) IS NOT NULL QUALIFY rank <= 8""")
def t22_exemplars(s, d):
    x = paired.overlap(V.step(s, d), "run_F", "run_O").join(V.statement(s, d), "stmt_hash").filter("a_score is not null and b_score is not null and belief is not null")
    return paired.exemplars(x, F.col("belief")).select("lane", F.col("rank").cast("bigint").alias("rank"), "stmt_hash", "evidence_hash")


_SIDE = "CASE WHEN nullif(trim(coalesce({0}.error, '')), '') IS NOT NULL THEN '{0} failed' WHEN {0}.score IS NULL THEN '{0} has no score' END"


@query(f""", {audit._LATEST}, fu AS (SELECT coalesce(a.stmt_hash, b.stmt_hash) AS stmt_hash, coalesce(a.evidence_hash, b.evidence_hash) AS evidence_hash, a.step_hash AS sa, b.step_hash AS sb,
    concat_ws(', ', {_SIDE.format('a')}, {_SIDE.format('b')}) AS why, greatest(a.started_at, b.started_at) AS newest
    FROM (SELECT * FROM latest WHERE run_id = 'run_F') a FULL JOIN (SELECT * FROM latest WHERE run_id = 'run_O') b ON a.stmt_hash = b.stmt_hash AND a.evidence_hash = b.evidence_hash),
  ln AS (SELECT *, CASE WHEN sb IS NULL THEN 'a_only' WHEN sa IS NULL THEN 'b_only' WHEN why <> '' THEN 'excluded' END AS lane FROM fu)
  SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY newest DESC NULLS LAST, stmt_hash, evidence_hash) AS rank, stmt_hash, evidence_hash, CASE WHEN lane = 'excluded' THEN why END AS reason FROM ln WHERE lane IS NOT NULL QUALIFY rank <= 8""")
def t22_side_lanes(s, d):
    x = paired.side_lanes(paired.overlap(V.step(s, d), "run_F", "run_O", "full"))
    return x.select("lane", F.col("rank").cast("bigint").alias("rank"), "stmt_hash", "evidence_hash", "reason")


@query("SELECT run_id, count(*) AS steps, count(DISTINCT evidence_hash) AS evidences, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, round(CASE WHEN count(DISTINCT evidence_hash) > 0 THEN sum(latency_ms) / 1000.0 / count(DISTINCT evidence_hash) END, 6) AS seconds_per_evidence, round(CAST(sum(prompt_tokens) FILTER (prompt_tokens >= 0) AS DOUBLE) / count(DISTINCT evidence_hash), 6) AS tokens_per_evidence FROM step_v GROUP BY 1")
def t21_resources(s, d):
    n = F.countDistinct("evidence_hash")
    x = V.step(s, d).groupBy("run_id").agg(F.count("*").alias("steps"), n.alias("evidences"), F.sum("latency_ms").alias("latency_ms"), F.sum(F.when(F.col("prompt_tokens") >= 0, F.col("prompt_tokens"))).alias("t"))
    return rounded(x.select("run_id", "steps", "evidences", "latency_ms", (F.col("latency_ms") / 1000.0 / F.col("evidences")).alias("seconds_per_evidence"), (F.col("t") / F.col("evidences")).alias("tokens_per_evidence")))


@query("SELECT (SELECT count(*) FROM statement_v) AS statements, (SELECT count(*) FROM evidence_v) AS evidences, (SELECT count(*) FROM membership_v) AS memberships, (SELECT count(*) FROM truth_label_v) AS labels, (SELECT count(DISTINCT run_id) FROM step_v) AS runs")
def t1_overview(s, d):
    parts = [V.statement(s, d), V.evidence(s, d), V.membership(s, d), V.truth_label(s, d), V.step(s, d).select("run_id").distinct()]
    names = ["statements", "evidences", "memberships", "labels", "runs"]
    out = parts[0].agg(F.count("*").alias(names[0])).withColumn("__k", F.lit(1))
    for p, n in zip(parts[1:], names[1:]):
        out = out.join(p.agg(F.count("*").alias(n)).withColumn("__k", F.lit(1)), "__k")
    return out.drop("__k")


@query("SELECT source_dump_id, count(*) AS n, count(DISTINCT stmt_hash) AS statements FROM statement GROUP BY 1 ORDER BY n DESC, source_dump_id LIMIT 16", views=False)
def t1_top_dumps(s, d):
    x = table(s, d, "statement").groupBy("source_dump_id").agg(F.count("*").alias("n"), F.countDistinct("stmt_hash").alias("statements"))
    return x.orderBy(F.desc("n"), F.asc_nulls_last("source_dump_id")).limit(16)


@query(_RES + "SELECT run_id, stmt_hash, round(residual, 9) AS residual FROM res ORDER BY abs(round(residual, 9)) DESC, run_id, stmt_hash LIMIT 100")
def l1_topk(s, d):
    x = audit._res(s, d).select("run_id", "stmt_hash", F.round("residual", 9).alias("residual"))
    return x.orderBy(F.desc(F.abs("residual")), "run_id", "stmt_hash").limit(100)


@query("SELECT DISTINCT stmt_hash, evidence_hash FROM step_v WHERE run_id = 'run_O' INTERSECT SELECT DISTINCT stmt_hash, evidence_hash FROM step_v WHERE run_id = 'run_F'")
def u3_key_intersection(s, d):
    st = V.step(s, d)
    return st.filter("run_id = 'run_O'").select("stmt_hash", "evidence_hash").intersect(st.filter("run_id = 'run_F'").select("stmt_hash", "evidence_hash"))


@query("SELECT DISTINCT stmt_hash, evidence_hash FROM membership_v EXCEPT SELECT stmt_hash, evidence_hash FROM step_v WHERE run_id = 'run_O'")
def u4_key_difference(s, d):
    return V.membership(s, d).subtract(V.step(s, d).filter("run_id = 'run_O'").select("stmt_hash", "evidence_hash"))


def _judged(s: SparkSession, d: str) -> DataFrame:
    return windows.gold(V.truth_label(s, d), audit._latest(s, d), ("score", "confidence"))


_J = f", {audit._GOLD}, sd AS (SELECT DISTINCT step_hash, run_id, stmt_hash, evidence_hash, score FROM step_v), jd AS (SELECT g.*, sd.score FROM g JOIN sd USING (step_hash, run_id, stmt_hash, evidence_hash)) "
_EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.001]
_BINS = ", bn AS (SELECT CAST(" + " + ".join(f"(score >= {e})::INT" for e in _EDGES) + " - 1 AS INT) AS bin, score, (gold = 'correct')::INT AS t FROM jd WHERE score IS NOT NULL), bb AS (SELECT bin, count(*) AS n, avg(score) AS confidence, avg(t) AS accuracy FROM bn WHERE bin BETWEEN 0 AND 9 GROUP BY 1) "


@query(_J + _BINS + "SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(abs(confidence - accuracy), 6) AS gap FROM bb")
def e8_reliability_bins(s, d):
    return rounded(evaluation.reliability_bins(_judged(s, d), F.col("score"), F.col("gold") == "correct", _EDGES))


@query(_J + _BINS + "SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM bb")
def e5_ece(s, d):
    return rounded(evaluation.ece(evaluation.reliability_bins(_judged(s, d), F.col("score"), F.col("gold") == "correct", _EDGES)))


#: Bins of the holdout's calibration error; a missing score and a score of 0 count as one half there.
_HOLDOUT_EDGES = [0.0, 0.05, 0.20, 0.35, 0.50, 0.65, 0.80, 0.95, 1.001]


@query(_J + ", hs AS (SELECT coalesce(nullif(score, 0), 0.5) AS s, (gold = 'correct')::INT AS t FROM jd), hb AS (SELECT " + " + ".join(f"(s >= {e})::INT" for e in _HOLDOUT_EDGES) + """ AS bin, count(*) AS n, abs(avg(s) - avg(t)) AS gap FROM hs GROUP BY 1)
  SELECT round(sum(n * gap) FILTER (bin BETWEEN 1 AND 8) / (SELECT count(*) FROM hs), 6) AS ece, CAST(sum(n) FILTER (bin BETWEEN 1 AND 8) AS BIGINT) AS n FROM hb""")
def e5_holdout_ece(s, d):
    x = _judged(s, d).select(F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(0.5)).alias("score"), (F.col("gold") == "correct").alias("t"))
    bins = evaluation.reliability_bins(x, F.col("score"), F.col("t"), _HOLDOUT_EDGES)
    total = x.agg(F.count("*").alias("total"))
    return rounded(evaluation.ece(bins.crossJoin(F.broadcast(total)), F.max("total")))


@query(_J + "SELECT run_id, round(avg(pow(score - (gold = 'correct')::INT, 2)), 6) AS brier FROM jd GROUP BY 1")
def e6_brier(s, d):
    return rounded(evaluation.brier(_judged(s, d), F.col("score"), F.col("gold") == "correct", ["run_id"]))


@query(_J + ", g2 AS (SELECT round(score, 6) AS s, sum((gold = 'correct')::INT) AS tp, count(*) AS n FROM jd WHERE score IS NOT NULL GROUP BY 1), c AS (SELECT tp, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(n) OVER (ORDER BY s DESC) AS cn FROM g2) SELECT round(sum(tp * ctp / cn) / sum(tp), 6) AS auprc FROM c")
def e7_auprc(s, d):
    return rounded(evaluation.average_precision(_judged(s, d), F.round("score", 6), F.col("gold") == "correct"))


@query(_J + "SELECT run_id, gold_field, verdict, count(*) AS n, round(avg((verdict = gold)::INT), 6) AS correct_rate FROM jd GROUP BY 1, 2, 3")
def e9_call_rates(s, d):
    x = _judged(s, d).groupBy("run_id", "gold_field", "verdict").agg(F.count("*").alias("n"), F.avg((F.col("verdict") == F.col("gold")).cast("int")).alias("correct_rate"))
    return rounded(x)


_DISC = _PAIR + f", gl AS (SELECT target_id AS evidence_hash, min(value_text) AS gold FROM truth_label_v GROUP BY 1), dd AS (SELECT (a_verdict = gold) AS a, (b_verdict = gold) AS b FROM pr JOIN gl USING (evidence_hash)), dc AS (SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM dd) "


@query(_DISC + "SELECT * FROM dc")
def e4_discordance(s, d):
    g = V.truth_label(s, d).groupBy(F.col("target_id").alias("evidence_hash")).agg(F.min("value_text").alias("gold"))
    x = paired.overlap(V.step(s, d), "run_F", "run_O").join(g, "evidence_hash")
    return evaluation.discordance(x, F.col("a_verdict") == F.col("gold"), F.col("b_verdict") == F.col("gold"))


@query(_DISC + """SELECT a_only AS b, b_only AS c, round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))
  FROM (SELECT a_only + b_only AS n, unnest(range(greatest(a_only, b_only), a_only + b_only + 1)) AS i))) END, 9) AS p FROM dc""")
def e3_mcnemar(s, d):
    r = e4_discordance(s, d).first()
    return s.createDataFrame([(r["a_only"], r["b_only"], round(evaluation.mcnemar(r["a_only"], r["b_only"]), 9))], "b bigint, c bigint, p double")


@query("SELECT run_id, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.9), 6) AS p90 FROM step_v GROUP BY 1")
def e15_percentiles(s, d):
    return rounded(V.step(s, d).groupBy("run_id").agg(F.percentile("score", F.lit(0.5)).alias("median"), F.percentile("score", F.lit(0.9)).alias("p90")))


_POOL = "pl AS (SELECT record_id AS id, CASE WHEN lower(trim(tag)) = 'correct' THEN 'correct' ELSE 'other' END AS cls, split FROM fewshot_pool WHERE tag IS NOT NULL) "


@query("WITH " + _POOL + "SELECT id, cls FROM pl WHERE split <> 'test' QUALIFY row_number() OVER (PARTITION BY cls ORDER BY id) <= 100", views=False)
def e12_balanced_holdout(s, d):
    p = table(s, d, "fewshot_pool").filter("tag is not null").select(F.col("record_id").alias("id"), F.when(F.lower(F.trim("tag")) == "correct", "correct").otherwise("other").alias("cls"), "split")
    return evaluation.capped_sample(p, "cls", 100, F.col("id"), p.filter("split = 'test'")).select("id", "cls")


_NORM = r"""lower(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '[.!?,;:"'']+$', ''))"""


@query(f"""WITH a AS (SELECT record_id AS example_id, {_NORM.format('evidence_text')} AS x FROM fewshot_pool), b AS (SELECT item_id AS eval_id, {_NORM.format('text')} AS y FROM eval_item)
  SELECT example_id, eval_id, CASE WHEN x = y THEN 'exact' WHEN (length(x) >= 30 AND contains(y, x)) OR (length(y) >= 30 AND contains(x, y)) THEN 'contained' ELSE 'shingle' END AS kind FROM a JOIN b
  ON x <> '' AND y <> '' AND (x = y OR (length(x) >= 30 AND contains(y, x)) OR (length(y) >= 30 AND contains(x, y)) OR len(list_filter(range(0, greatest(0, length(x) - 49), 5), lambda i: contains(y, substr(x, CAST(i + 1 AS INT), 50)))) > 0)""", views=False)
def e13_contamination(s, d):
    a = table(s, d, "fewshot_pool").select(F.col("record_id").alias("id"), F.col("evidence_text").alias("text"))
    return evaluation.contamination(a, table(s, d, "eval_item").select(F.col("item_id").alias("id"), "text"))


_DOC = "(SELECT CASE json_type(j) WHEN 'OBJECT' THEN j END AS j, stmt_hash AS own FROM (SELECT TRY_CAST(raw_json AS JSON) AS j, stmt_hash FROM statement))"
_HEX = "lpad(lower(to_hex(CAST({} AS BIGINT))), 16, '0')"
_S = _HEX.format("json_extract_string(j, '$.matches_hash')")


@query(f"SELECT DISTINCT {_S} AS stmt_hash, json_extract_string(j, '$.id') AS uuid, json_extract_string(j, '$.type') AS stmt_type, CASE WHEN coalesce(CAST(json_extract(j, '$.belief') AS DOUBLE), 0) = 0 THEN 1.0 ELSE CAST(json_extract(j, '$.belief') AS DOUBLE) END AS belief, CAST(coalesce(json_array_length(j, '$.supports'), 0) AS INT) AS supports_count, CAST(coalesce(json_array_length(j, '$.supported_by'), 0) AS INT) AS supported_by_count FROM {_DOC} WHERE j IS NOT NULL", views=False)
def i2_statement_rows(s, d):
    return ingest.statements(ingest.parsed(table(s, d, "statement"))).distinct()


_MEM = f"(SELECT {_S} AS stmt_hash, {_HEX.format('''json_extract_string(e, '$.source_hash')''')} AS evidence_hash, i AS evidence_index, e FROM (SELECT j, unnest(json_extract(j, '$.evidence[*]')) AS e, unnest(range(len(json_extract(j, '$.evidence[*]')))) AS i FROM {_DOC} WHERE json_type(j, '$.evidence') = 'ARRAY'))"


@query(f"SELECT DISTINCT stmt_hash, evidence_hash, evidence_index FROM {_MEM}", views=False)
def i3_evidence_ordinals(s, d):
    return ingest.memberships(ingest.parsed(table(s, d, "statement"))).select("stmt_hash", "evidence_hash", F.col("evidence_index").cast("bigint").alias("evidence_index")).distinct()


@query(f"""WITH a AS (SELECT {_S} AS stmt_hash, j, coalesce(json_type(j, '$.members') = 'ARRAY' AND json_array_length(j, '$.members') > 0, false) AS m, json_type(j, '$.enz') = 'OBJECT' OR json_type(j, '$.sub') = 'OBJECT' AS e, json_type(j, '$.subj') = 'OBJECT' OR json_type(j, '$.obj') = 'OBJECT' AS o FROM {_DOC} WHERE j IS NOT NULL),
  r AS (SELECT stmt_hash, 'member' AS role, i AS role_index, x FROM (SELECT stmt_hash, unnest(json_extract(j, '$.members[*]')) AS x, unnest(range(len(json_extract(j, '$.members[*]')))) AS i FROM a WHERE m)
  UNION ALL SELECT stmt_hash, t.role, 0, json_extract(j, '$.' || t.role) FROM a, (VALUES ('enz'), ('sub')) t(role) WHERE NOT m AND coalesce(e, false)
  UNION ALL SELECT stmt_hash, t.role, 0, json_extract(j, '$.' || t.role) FROM a, (VALUES ('subj'), ('obj')) t(role) WHERE NOT m AND NOT coalesce(e, false) AND coalesce(o, false)
  UNION ALL SELECT stmt_hash, 'agent', 0, json_extract(j, '$.agent') FROM a WHERE NOT m AND NOT coalesce(e, false) AND NOT coalesce(o, false))
  SELECT DISTINCT stmt_hash, role, role_index, json_extract_string(x, '$.name') AS name FROM r WHERE json_type(x) = 'OBJECT'""", views=False)
def i4_agent_slots(s, d):
    return ingest.agents(ingest.parsed(table(s, d, "statement"))).select("stmt_hash", "role", F.col("role_index").cast("bigint").alias("role_index"), "name").distinct()


@query(f"""WITH k AS (SELECT json_extract_string(j, '$.id') AS id, min({_S}) AS k FROM {_DOC} WHERE j IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT {_S} AS from_hash, 'supports' AS kind, unnest(json_extract_string(j, '$.supports[*]')) AS to_id FROM {_DOC} WHERE json_type(j, '$.supports') = 'ARRAY'
  UNION SELECT DISTINCT {_S}, 'supported_by', unnest(json_extract_string(j, '$.supported_by[*]')) FROM {_DOC} WHERE json_type(j, '$.supported_by') = 'ARRAY') SELECT from_hash, coalesce(k, to_id) AS to_hash, kind FROM e LEFT JOIN k ON k.id = e.to_id""", views=False)
def i12_support_edges(s, d):
    return ingest.edges(ingest.parsed(table(s, d, "statement")))


@query(f"""WITH m AS (SELECT DISTINCT evidence_hash, json_extract_string(e, '$.epistemics.direct') AS direct, json_extract_string(e, '$.epistemics.negated') AS negated, json_extract_string(e, '$.epistemics.curated') AS curated FROM {_MEM})
  SELECT count(DISTINCT evidence_hash) AS evidences, count(DISTINCT evidence_hash) FILTER (direct = 'true') AS direct, count(DISTINCT evidence_hash) FILTER (negated = 'true') AS negated, count(DISTINCT evidence_hash) FILTER (curated = 'true') AS curated FROM m""", views=False)
def i5_epistemics(s, d):
    e = ingest.memberships(ingest.parsed(table(s, d, "statement"))).select("evidence_hash", "e.epistemics.*").distinct()
    n = lambda c: F.countDistinct(F.when(F.col(c), F.col("evidence_hash"))).alias(c)
    return e.agg(F.countDistinct("evidence_hash").alias("evidences"), n("direct"), n("negated"), n("curated"))


@query("""WITH w AS (SELECT stmt_hash, max(coalesce(CASE WHEN json_type(raw_json, '$.evidence') = 'ARRAY' THEN json_array_length(raw_json, '$.evidence') END, 0)) AS expected FROM statement WHERE json_valid(raw_json) AND json_type(raw_json) = 'OBJECT' GROUP BY 1),
  h AS (SELECT stmt_hash, count(DISTINCT evidence_hash) AS stored FROM statement_evidence GROUP BY 1) SELECT stmt_hash, CAST(expected AS INT) AS expected, coalesce(stored, 0) AS stored FROM w LEFT JOIN h USING (stmt_hash) WHERE expected <> coalesce(stored, 0)""", views=False)
def i16_denominators(s, d):
    return ingest.denominators(ingest.parsed(table(s, d, "statement")), table(s, d, "statement_evidence"))


@query("""SELECT stmt_hash, count(DISTINCT evidence_hash) AS old_n, count(DISTINCT evidence_hash) FILTER (loaded_at < TIMESTAMP '2032-01-01') AS new_n FROM statement_evidence WHERE stmt_hash IS NOT NULL AND evidence_hash IS NOT NULL GROUP BY 1 HAVING new_n > 0 AND new_n <> old_n""", views=False)
def i7_membership_conflicts(s, d):
    m = table(s, d, "statement_evidence").filter("stmt_hash is not null and evidence_hash is not null")
    return ingest.conflicts(m, m.filter("loaded_at < timestamp_ntz'2032-01-01'"))


@query("SELECT step_hash, CASE verdict WHEN 'correct' THEN CASE confidence WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.80 ELSE 0.65 END WHEN 'incorrect' THEN CASE confidence WHEN 'low' THEN 0.35 WHEN 'medium' THEN 0.20 ELSE 0.05 END ELSE 0.5 END::DOUBLE AS s FROM step_v")
def c3_score_grid(s, d):
    return V.step(s, d).select("step_hash", scalars.score_of(F.col("verdict"), F.col("confidence")).alias("s"))


@query("SELECT step_hash, CASE WHEN round(abs(score - 0.5), 9) >= 0.4 THEN 'high' WHEN round(abs(score - 0.5), 9) >= 0.2 THEN 'medium' WHEN score IS NOT NULL THEN 'low' END AS c, round(CASE WHEN score IS NOT NULL THEN 1 / (1 + exp(-0.85 * ln(least(0.999999, greatest(0.000001, score)) / (1 - least(0.999999, greatest(0.000001, score)))))) END, 6) AS shrunk FROM step_v")
def c33_logit_shrink(s, d):
    return V.step(s, d).select("step_hash", scalars.confidence_of(F.col("score")).alias("c"), F.round(scalars.shrunk(F.col("score")), 6).alias("shrunk"))


@query("SELECT record_id, " + _HEX.format("source_hash") + " AS hex, substr(sha256(concat_ws('|', coalesce(source_api, 'None'), coalesce(pmid, 'None'), coalesce(evidence_text, 'None'))), 1, 16) AS k FROM fewshot_pool", views=False)
def c2_content_keys(s, d):
    return table(s, d, "fewshot_pool").select("record_id", ingest.hex16(F.col("source_hash")).alias("hex"), ingest.content_key(F.col("source_api"), F.col("pmid"), F.col("evidence_text")).alias("k"))


def _alias_sql(c: str) -> str:
    x = f"lower({c})"
    for g, n in scalars.GREEK.items():
        x = f"replace({x}, '{g}', '{n}')"
    return f"regexp_replace({x}, '[^a-z0-9]', '', 'g')"


@query(f"SELECT DISTINCT name, {_alias_sql('name')} AS a FROM agent", views=False)
def c7_aliases(s, d):
    return table(s, d, "agent").select("name", scalars.plain_alias(F.col("name")).alias("a")).distinct()


@query(r"SELECT record_id, CASE WHEN length(subject) <= 4 THEN regexp_matches(lower(evidence_text), '(^|[^a-z])' || lower(subject) || '($|[^a-z])') ELSE contains(lower(evidence_text), lower(subject)) END AS m FROM fewshot_pool", views=False)
def c24_mentions(s, d):
    return table(s, d, "fewshot_pool").select("record_id", scalars.mentions(F.col("evidence_text"), F.col("subject")).alias("m"))


@query("SELECT record_id, TRY_CAST(nullif(trim(pmid), '') AS BIGINT) AS pmid, coalesce(nullif(trim(curator_note), ''), 'none') AS note FROM fewshot_pool", views=False)
def c30_try_cast(s, d):
    note = F.coalesce(F.nullif(F.trim("curator_note"), F.lit("")), F.lit("none"))
    return table(s, d, "fewshot_pool").select("record_id", F.expr("try_cast(nullif(trim(pmid), '') as bigint)").alias("pmid"), note.alias("note"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace({_STRIP.format('text')}, '([.?!])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda p: {_STRIP.format('p')}), lambda p: length(p) >= 12)"""


@query(f"SELECT doc_id, CASE WHEN {_STRIP.format("coalesce(text, '')")} = '' THEN [] WHEN len(p) < 2 THEN [text] ELSE list_slice(p, 1, 4) END AS clauses FROM (SELECT doc_id, text, {_SENTENCES} AS p FROM documents)", views=False)
def c20_clauses(s, d):
    return table(s, d, "documents").select("doc_id", scalars.clauses(F.col("text")).alias("clauses"))


def _tokens_sql(c: str) -> str:
    x = f"lower(coalesce({c}, ''))"
    for g, n in scalars.TOKEN_GREEK.items():
        x = f"replace({x}, '{g}', '{n}')"
    return f"list_filter(regexp_extract_all({x}, '[a-z]+|\\d+'), lambda t: t NOT IN ({', '.join(repr(t) for t in scalars.GENERIC_TOKENS)}))"


@query(f"SELECT record_id, len(k) AS shared, coalesce(length(object) >= 3 AND len(k) > 0, false) AS matches FROM (SELECT record_id, object, list_distinct(list_intersect({_tokens_sql('evidence_text')}, {_tokens_sql('object')})) AS k FROM fewshot_pool)", views=False)
def c25_token_overlap(s, d):
    shared = F.size(F.array_intersect(scalars.specific_tokens(F.col("evidence_text")), scalars.specific_tokens(F.col("object")))).cast("bigint")
    return table(s, d, "fewshot_pool").select("record_id", shared.alias("shared"), F.coalesce((F.length("object") >= 3) & (shared > 0), F.lit(False)).alias("matches"))


def _folded_sql(c: str) -> str:
    x = f"lower({c})"
    for name, (letter, short) in scalars.GREEK_SHORT.items():
        x = f"replace(replace({x}, '{name}', '{short}'), '{letter}', '{short}')"
    return f"nullif(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"


@query(f"SELECT DISTINCT name, {_folded_sql('name')} AS folded FROM (SELECT name FROM agent UNION SELECT json_extract_string(CASE WHEN json_valid(db_refs_json) THEN db_refs_json END, '$.TEXT') FROM agent)", views=False)
def c7_folded_names(s, d):
    a = table(s, d, "agent")
    names = a.select("name").union(a.select(F.get_json_object("db_refs_json", "$.TEXT"))).distinct()
    return names.select("name", scalars.folded_alias(F.col("name")).alias("folded"))


@query()
def c14_local_hedges(s, d):
    p = table(s, d, "fewshot_pool")
    return p.select("record_id", textrules.local_hedges(F.col("evidence_text"), F.array("subject", "object")).alias("markers")).filter(F.size("markers") > 0)


def _at_sql(c: str) -> str:
    pieces = f"string_split_regex(evidence_text, '(?i)\\b\\Q' || {c} || '\\E\\b')"
    return f"CASE WHEN evidence_text <> '' AND length({c}) >= 2 THEN list_transform(range(1, len({pieces})), lambda i: CAST(list_sum(list_transform(list_slice({pieces}, 1, i), lambda p: length(p))) + (i - 1) * length({c}) AS INT)) ELSE [] END"


@query(f"SELECT record_id, {_at_sql('subject')} AS subject_at, {_at_sql('object')} AS object_at FROM fewshot_pool", views=False)
def c9_alias_positions(s, d):
    p = table(s, d, "fewshot_pool")
    at = {c: textrules.alias_positions(F.col("evidence_text"), F.array(c)) for c in ("subject", "object")}
    return p.select("record_id", at["subject"].alias("subject_at"), at["object"].alias("object_at"))
