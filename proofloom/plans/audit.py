"""Queries of aggregation, windows, joins and belief over the audit model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.operators import belief, validity, windows
from proofloom.plans import views as V
from proofloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that follows the views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = V.SQL + sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, so that the order of summation does not show."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SCORES = "scores AS (SELECT run_id, stmt_hash, avg(score) AS our_score, count(*) AS n_evidence FROM step_v GROUP BY 1, 2), res AS (SELECT *, our_score - belief AS residual FROM scores JOIN statement_v USING (stmt_hash) WHERE our_score IS NOT NULL AND belief IS NOT NULL)"
_CAL = "count(*) AS n_stmts, round(avg(abs(residual)), 6) AS mae, round(sqrt(avg(residual * residual)), 6) AS rmse, round(avg(residual), 6) AS bias"


def _scores(s: SparkSession, d: str) -> DataFrame:
    return validity.statement_scores(V.step(s, d))


def _res(s: SparkSession, d: str) -> DataFrame:
    return validity.residuals(_scores(s, d), V.statement(s, d))


@query("SELECT run_id, stmt_hash, round(avg(score), 6) AS our_score, count(*) AS n_evidence FROM step_v GROUP BY 1, 2")
def a1_mean_score(s, d):
    return rounded(_scores(s, d))


@query("SELECT stmt_hash, round(1 - product(greatest(0, least(1, 1 - score))) FILTER (score IS NOT NULL), 9) AS noisy_or, round(avg(score), 6) AS mean FROM step_v GROUP BY 1")
def a3_noisy_or(s, d):
    return V.step(s, d).groupBy("stmt_hash").agg(F.round(belief.noisy_or(F.col("score")), 9).alias("noisy_or"), r6(F.avg("score")).alias("mean"))


@query("SELECT run_id, verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY run_id), 6) AS share FROM step_v GROUP BY 1, 2")
def a5_verdict_shares(s, d):
    return rounded(validity.shares(V.step(s, d)))


@query(f", {_SCORES} SELECT run_id, {_CAL} FROM res GROUP BY 1")
def a6_calibration(s, d):
    return rounded(validity.calibration(_res(s, d), ["run_id"]))


@query("SELECT run_id, count(*) AS n_multi, round(avg(sd), 6) AS mean_stdev, round(max(sd), 6) AS max_stdev FROM (SELECT run_id, stmt_hash, stddev_pop(score) AS sd FROM step_v WHERE score IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def a7_consistency(s, d):
    return rounded(validity.consistency(V.step(s, d)))


@query(f", {_SCORES} SELECT run_id, stmt_type, {_CAL} FROM res GROUP BY 1, 2 HAVING count(*) >= 2")
def a8_stratified_calibration(s, d):
    return rounded(validity.calibration(_res(s, d), ["run_id", "stmt_type"], 2))


@query(f", {_SCORES}, src AS (SELECT stmt_hash, min(source_api) AS source_api FROM membership_v JOIN evidence_v USING (evidence_hash) GROUP BY 1) SELECT run_id, source_api, {_CAL} FROM res JOIN src USING (stmt_hash) GROUP BY 1, 2 HAVING count(*) >= 2")
def a8_source_calibration(s, d):
    src = V.membership(s, d).join(V.evidence(s, d), "evidence_hash").groupBy("stmt_hash").agg(F.min("source_api").alias("source_api"))
    return rounded(validity.calibration(_res(s, d).join(src, "stmt_hash"), ["run_id", "source_api"], 2))


_LATEST = "latest AS (SELECT * FROM step_v QUALIFY row_number() OVER (PARTITION BY run_id, stmt_hash, evidence_hash ORDER BY started_at DESC, step_hash DESC) = 1)"
_GOLD = f"""{_LATEST}, g AS (SELECT s.run_id, s.stmt_hash, s.evidence_hash, s.step_hash, s.verdict, l.value_text AS gold, l.field AS gold_field
  FROM latest s JOIN truth_label_v l ON l.target_id = s.evidence_hash AND (l.relation_target_id IS NULL OR l.relation_target_id = s.stmt_hash)
  QUALIFY row_number() OVER (PARTITION BY s.run_id, s.step_hash, s.stmt_hash, s.evidence_hash ORDER BY (l.relation_target_id IS NULL)::INT, (l.field <> 'verdict')::INT, l.value_text) = 1)"""
_KEY = ["run_id", "stmt_hash", "evidence_hash"]


def _latest(s: SparkSession, d: str) -> DataFrame:
    return windows.latest(V.step(s, d), _KEY)


def _gold(s: SparkSession, d: str) -> DataFrame:
    return windows.gold(V.truth_label(s, d), _latest(s, d))


@query(f", {_GOLD} SELECT run_id, stmt_hash, evidence_hash, step_hash, verdict, gold, gold_field FROM g")
def w1_gold_precedence(s, d):
    return _gold(s, d)


@query(f""", {_GOLD}, c AS (SELECT run_id, count(*) FILTER (verdict = 'correct' AND gold = 'correct') AS tp, count(*) FILTER (verdict = 'correct' AND gold <> 'correct') AS fp,
  count(*) FILTER (verdict <> 'correct' AND gold = 'correct') AS fn, count(*) FILTER (verdict <> 'correct' AND gold <> 'correct') AS tn FROM g GROUP BY 1)
  SELECT run_id, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def a9_confusion(s, d):
    return rounded(validity.confusion(_gold(s, d), ["run_id"], F.col("verdict") == "correct", F.col("gold") == "correct"))


@query("""SELECT field, value_text, count(*) AS n, count(relation_target_id) AS contextual, count(*) FILTER (EXISTS (SELECT 1 FROM step_v s WHERE s.evidence_hash = l.target_id AND (l.relation_target_id IS NULL OR l.relation_target_id = s.stmt_hash))) AS applicable
  FROM truth_label_v l GROUP BY 1, 2""")
def a10_gold_summary(s, d):
    lab = V.truth_label(s, d)
    steps = V.step(s, d).select("evidence_hash", "stmt_hash").distinct()
    on = (F.col("l.target_id") == F.col("s.evidence_hash")) & (F.col("l.relation_target_id").isNull() | (F.col("l.relation_target_id") == F.col("s.stmt_hash")))
    hit = lab.alias("l").join(steps.alias("s"), on, "left_semi").withColumn("hit", F.lit(1))
    all_of = lab.withColumn("hit", F.lit(0)).unionByName(hit)
    first = F.col("hit") == 0
    return all_of.groupBy("field", "value_text").agg(F.count_if(first).alias("n"), F.count_if(first & F.col("relation_target_id").isNotNull()).alias("contextual"), F.count_if(~first).alias("applicable"))


@query("SELECT l.* FROM truth_label_v l WHERE EXISTS (SELECT 1 FROM step_v s WHERE s.run_id = 'run_O' AND s.evidence_hash = l.target_id AND (l.relation_target_id IS NULL OR l.relation_target_id = s.stmt_hash))")
def j5_applicable_labels(s, d):
    steps = V.step(s, d).filter("run_id = 'run_O'").select("evidence_hash", "stmt_hash").distinct()
    on = (F.col("l.target_id") == F.col("s.evidence_hash")) & (F.col("l.relation_target_id").isNull() | (F.col("l.relation_target_id") == F.col("s.stmt_hash")))
    return V.truth_label(s, d).alias("l").join(steps.alias("s"), on, "left_semi")


@query(f", {_SCORES} SELECT run_id, round(avg(our_score) FILTER (has_supports), 6) AS with_supports, round(avg(our_score) FILTER (NOT has_supports), 6) AS without_supports, round(avg(our_score) FILTER (has_supports) - avg(our_score) FILTER (NOT has_supports), 6) AS delta, CAST(NULL AS VARCHAR) AS unavailable_reason FROM scores JOIN statement_v USING (stmt_hash) WHERE our_score IS NOT NULL GROUP BY 1")
def a11_supports_delta(s, d):
    return rounded(validity.supports_delta(_scores(s, d), V.statement(s, d)))


@query(f""", {_SCORES}, cal AS (SELECT run_id, avg(abs(residual)) AS mae, sqrt(avg(residual * residual)) AS rmse, avg(residual) AS bias FROM res GROUP BY 1),
  st AS (SELECT run_id, stmt_type, avg(abs(residual)) AS mae FROM res GROUP BY 1, 2 HAVING count(*) >= 2),
  sh AS (SELECT run_id, verdict, count(*) / sum(count(*)) OVER (PARTITION BY run_id) AS share FROM step_v GROUP BY 1, 2)
  SELECT run_id, metric_name, slice_json, round(value, 6) AS value FROM (
  SELECT run_id, 'calibration.mae' AS metric_name, '{{}}' AS slice_json, mae AS value FROM cal UNION ALL SELECT run_id, 'calibration.rmse', '{{}}', rmse FROM cal UNION ALL SELECT run_id, 'calibration.bias', '{{}}', bias FROM cal
  UNION ALL SELECT run_id, 'stratified.mae', '{{"stmt_type":"' || stmt_type || '"}}', mae FROM st UNION ALL SELECT run_id, 'verdict.share', '{{"verdict":"' || verdict || '"}}', share FROM sh)""")
def a12_metrics(s, d):
    res = _res(s, d)
    cal = {"mae": "mae", "rmse": "rmse", "bias": "bias"}
    frames = {
        "calibration": (validity.calibration(res, ["run_id"]), cal, []),
        "stratified": (validity.calibration(res, ["run_id", "stmt_type"], 2), {"mae": "mae"}, ["stmt_type"]),
        "verdict": (validity.shares(V.step(s, d)), {"share": "share"}, ["verdict"]),
    }
    return rounded(validity.metric_rows(frames))


@query("""SELECT run_id, coalesce(stmt_type, 'all') AS stmt_type, confidence, count(*) AS n, round(avg(abs(score - belief)), 6) AS mae
  FROM step_v JOIN statement_v USING (stmt_hash) WHERE score IS NOT NULL AND belief IS NOT NULL GROUP BY GROUPING SETS ((run_id, confidence), (run_id, stmt_type, confidence)) HAVING count(*) >= 2""")
def a13_confidence_calibration(s, d):
    x = V.step(s, d).join(V.statement(s, d), "stmt_hash").filter("score is not null and belief is not null").withColumn("e", F.abs(F.col("score") - F.col("belief")))
    g = x.groupingSets([["run_id", "confidence"], ["run_id", "stmt_type", "confidence"]], "run_id", "stmt_type", "confidence").agg(F.count("*").alias("n"), r6(F.avg("e")).alias("mae"))
    return g.filter("n >= 2").withColumn("stmt_type", F.coalesce("stmt_type", F.lit("all")))


_LEDGER = """SELECT CAST(NULL AS VARCHAR) AS run_id, 'corpus' AS family, 'statements' AS kind, count(*) AS value FROM statement_v UNION ALL SELECT NULL, 'corpus', 'evidences', count(*) FROM evidence_v
  UNION ALL SELECT NULL, 'corpus', 'memberships', count(*) FROM membership_v UNION ALL SELECT NULL, 'labels', field, count(*) FROM truth_label_v GROUP BY field
  UNION ALL SELECT run_id, 'run', 'steps', count(*) FROM step_v GROUP BY run_id UNION ALL SELECT run_id, 'run', 'evidences', count(DISTINCT evidence_hash) FROM step_v GROUP BY run_id
  UNION ALL SELECT run_id, 'run', 'pairs', count(DISTINCT (stmt_hash, evidence_hash)) FROM step_v GROUP BY run_id"""


@query(_LEDGER)
def a14_denominator_ledger(s, d):
    none = F.lit(None).cast("string").alias("run_id")

    def total(df: DataFrame, family: str, kind: Column, keys: list[str], value: Column) -> DataFrame:
        x = df.groupBy(*keys).agg(value.alias("value")) if keys else df.agg(value.alias("value"))
        return x.select(F.col("run_id") if "run_id" in keys else none, F.lit(family).alias("family"), kind.alias("kind"), "value")

    st = V.step(s, d)
    parts = [
        total(V.statement(s, d), "corpus", F.lit("statements"), [], F.count("*")),
        total(V.evidence(s, d), "corpus", F.lit("evidences"), [], F.count("*")),
        total(V.membership(s, d), "corpus", F.lit("memberships"), [], F.count("*")),
        total(V.truth_label(s, d), "labels", F.col("field"), ["field"], F.count("*")),
        total(st, "run", F.lit("steps"), ["run_id"], F.count("*")),
        total(st, "run", F.lit("evidences"), ["run_id"], F.countDistinct("evidence_hash")),
        total(st, "run", F.lit("pairs"), ["run_id"], F.countDistinct("stmt_hash", "evidence_hash")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT run_id, family, kind, value FROM (" + _LEDGER + ") WHERE family = 'run' ORDER BY run_id NULLS FIRST, kind")
def a15_ledger_filter(s, d):
    return a14_denominator_ledger(s, d).filter("family = 'run'").orderBy(F.asc_nulls_first("run_id"), "kind")


@query("SELECT run_id, count(DISTINCT evidence_hash) AS n_evidence, count(DISTINCT stmt_hash) AS n_stmts FROM step_v GROUP BY 1")
def a16_distinct_evidence(s, d):
    return V.step(s, d).groupBy("run_id").agg(F.countDistinct("evidence_hash").alias("n_evidence"), F.countDistinct("stmt_hash").alias("n_stmts"))


@query("SELECT run_id, " + ", ".join(f"count(*) FILTER (step_kind = '{k}') AS n_{k}" for k in dict.fromkeys(V.KINDS)) + " FROM trace_v GROUP BY 1")
def a17_step_kind_counts(s, d):
    return V.trace_step(s, d).groupBy("run_id").agg(*[F.count_if(F.col("step_kind") == k).alias(f"n_{k}") for k in dict.fromkeys(V.KINDS)])


@query("SELECT run_id, stmt_hash, arg_max(evidence_hash, (score, evidence_hash)) AS best_evidence, max(score) AS best_score FROM step_v WHERE score IS NOT NULL GROUP BY 1, 2")
def a18_argmax(s, d):
    return V.step(s, d).filter("score is not null").groupBy("run_id", "stmt_hash").agg(F.max_by("evidence_hash", F.struct("score", "evidence_hash")).alias("best_evidence"), F.max("score").alias("best_score"))


@query("SELECT run_id, stmt_hash, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM trace_v GROUP BY 1, 2")
def a19_null_sum(s, d):
    return V.trace_step(s, d).groupBy("run_id", "stmt_hash").agg(F.sum("latency_ms").alias("latency_ms"))


@query("SELECT stmt_hash, CAST(sum(prompt_tokens) FILTER (prompt_tokens >= 0) AS BIGINT) AS prompt_tokens FROM step_v GROUP BY 1")
def a20_token_sums(s, d):
    return V.step(s, d).groupBy("stmt_hash").agg(F.sum(F.when(F.col("prompt_tokens") >= 0, F.col("prompt_tokens"))).alias("prompt_tokens"))


_ROLE = "CASE role WHEN 'enz' THEN 0 WHEN 'subj' THEN 0 WHEN 'sub' THEN 1 WHEN 'obj' THEN 1 ELSE 2 END"


@query(f"SELECT stmt_hash, string_agg(name, ', ' ORDER BY o, role_index, name) AS names FROM (SELECT DISTINCT stmt_hash, {_ROLE} AS o, role_index, name FROM agent WHERE stmt_hash IS NOT NULL AND name IS NOT NULL) GROUP BY 1")
def a21_agent_names(s, d):
    x = table(s, d, "agent").filter("stmt_hash is not null and name is not null").select("stmt_hash", F.expr(_ROLE).alias("o"), "role_index", "name").distinct()
    return x.groupBy("stmt_hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "role_index", "name"))), lambda a: a["name"]), ", ").alias("names"))


@query("SELECT stmt_hash, string_agg(DISTINCT source_api, ', ' ORDER BY source_api) AS sources FROM membership_v JOIN evidence_v USING (evidence_hash) GROUP BY 1")
def a22_source_lists(s, d):
    return V.membership(s, d).join(V.evidence(s, d), "evidence_hash").groupBy("stmt_hash").agg(F.array_join(F.array_sort(F.collect_set("source_api")), ", ").alias("sources"))


@query("SELECT stmt_hash, array_to_string(list(evidence_hash ORDER BY evidence_hash) FILTER (is_curated), ' ') AS curated FROM membership_v JOIN evidence_v USING (evidence_hash) GROUP BY 1 HAVING count(*) FILTER (is_curated) > 0")
def a24_filtered_lists(s, d):
    x = V.membership(s, d).join(V.evidence(s, d), "evidence_hash").groupBy("stmt_hash").agg(F.array_sort(F.collect_list(F.when(F.col("is_curated"), F.col("evidence_hash")))).alias("curated"))
    return x.filter(F.size("curated") > 0).withColumn("curated", F.array_join("curated", " "))


_LATTICE = "CASE WHEN count(*) FILTER (verdict = 'incorrect') > 0 THEN 'incorrect' WHEN count(*) FILTER (verdict = 'abstain') > 0 THEN 'abstain' WHEN count(*) FILTER (verdict = 'correct') = count(*) THEN 'correct' WHEN count(*) FILTER (verdict = 'correct') > 0 THEN 'mixed' ELSE 'unknown' END AS stmt_verdict"


@query(f"SELECT run_id, stmt_hash, {_LATTICE}, count(*) AS n_steps FROM step_v GROUP BY 1, 2")
def a27_verdict_lattice(s, d):
    return validity.verdict_lattice(V.step(s, d), ["run_id", "stmt_hash"])


@query("SELECT least(lower(subject), lower(object)) AS a, greatest(lower(subject), lower(object)) AS b, stmt_type, max(belief) AS best, count(*) AS n, CAST(sum(evidence_count) AS BIGINT) AS evidence FROM fewshot_pool WHERE subject IS NOT NULL AND object IS NOT NULL GROUP BY 1, 2, 3")
def a28_pair_rollup(s, d):
    x = table(s, d, "fewshot_pool").filter("subject is not null and object is not null")
    a, b = F.lower("subject"), F.lower("object")
    return x.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "stmt_type").agg(F.max("belief").alias("best"), F.count("*").alias("n"), F.sum("evidence_count").alias("evidence"))


@query("SELECT stmt_hash, source_api, count(*) AS n FROM membership_v JOIN evidence_v USING (evidence_hash) GROUP BY 1, 2")
def a29_source_counts(s, d):
    x = V.membership(s, d).join(V.evidence(s, d), "evidence_hash").groupBy("stmt_hash", "source_api").agg(F.count("*").alias("n"))
    m = x.groupBy("stmt_hash").agg(F.map_from_entries(F.collect_list(F.struct("source_api", "n"))).alias("source_counts"))
    return m.select("stmt_hash", F.explode("source_counts").alias("source_api", "n"))


@query("SELECT run_id, stmt_hash, min(started_at) AS first_at, max(started_at) AS last_at, datediff('second', min(started_at), max(started_at)) AS seconds FROM trace_v GROUP BY 1, 2")
def a31_first_last(s, d):
    x = V.trace_step(s, d).groupBy("run_id", "stmt_hash").agg(F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"))
    sec = F.floor(F.unix_micros(F.col("last_at").cast("timestamp")) / 1000000) - F.floor(F.unix_micros(F.col("first_at").cast("timestamp")) / 1000000)
    return x.withColumn("seconds", sec.cast("bigint"))


_RANK = "row_number() OVER (PARTITION BY run_id, stmt_hash, evidence_hash ORDER BY CASE WHEN error IS NOT NULL THEN 0 WHEN step_kind = 'aggregate' THEN 1 ELSE 2 END, started_at DESC, step_hash DESC)"


@query(f"SELECT run_id, stmt_hash, evidence_hash, step_hash, step_kind FROM trace_v QUALIFY {_RANK} = 1")
def w2_trace_representative(s, d):
    x = V.trace_step(s, d).withColumn("o", V.trace_output())
    kind = F.when(F.col("o.error").isNotNull(), 0).when(F.col("step_kind") == "aggregate", 1).otherwise(2)
    return windows.first_by(x.withColumn("r", kind), _KEY, [F.col("r"), F.desc("started_at"), F.desc("step_hash")]).select(*_KEY, "step_hash", "step_kind")


@query(f", {_LATEST} SELECT run_id, stmt_hash, evidence_hash, step_hash, score, verdict FROM latest")
def w3_latest_aggregate(s, d):
    return _latest(s, d).select(*_KEY, "step_hash", "score", "verdict")


@query("SELECT run_id, stmt_hash, evidence_hash, step_hash, round(abs(score - belief), 9) AS distance FROM step_v JOIN statement_v USING (stmt_hash) QUALIFY row_number() OVER (PARTITION BY run_id, stmt_hash ORDER BY (coalesce(confidence, '') <> 'high')::INT, abs(score - belief) DESC NULLS LAST, evidence_hash, step_hash) = 1")
def w4_statement_representative(s, d):
    x = V.step(s, d).join(V.statement(s, d), "stmt_hash").withColumn("distance", F.abs(F.col("score") - F.col("belief")))
    miss = (F.coalesce("confidence", F.lit("")) != "high").cast("int")
    return windows.first_by(x, ["run_id", "stmt_hash"], [miss, F.desc_nulls_last("distance"), F.col("evidence_hash"), F.col("step_hash")]).select("run_id", "stmt_hash", "evidence_hash", "step_hash", F.round("distance", 9).alias("distance"))


@query("SELECT stmt_type, stmt_hash, belief, row_number() OVER (PARTITION BY stmt_type ORDER BY belief DESC NULLS LAST, stmt_hash) AS rank FROM statement_v QUALIFY rank <= 40")
def w5_capped_listing(s, d):
    w = Window.partitionBy("stmt_type").orderBy(F.desc_nulls_last("belief"), "stmt_hash")
    return V.statement(s, d).select("stmt_type", "stmt_hash", "belief", F.row_number().over(w).cast("bigint").alias("rank")).filter("rank <= 40")


@query("SELECT stmt_hash, evidence_hash, started_at, count(*) OVER (PARTITION BY stmt_hash) AS siblings FROM step_v QUALIFY row_number() OVER (PARTITION BY stmt_hash ORDER BY started_at DESC, step_hash DESC) = 1")
def w6_latest_with_count(s, d):
    n = F.count("*").over(Window.partitionBy("stmt_hash")).alias("siblings")
    x = V.step(s, d).select("stmt_hash", "evidence_hash", "started_at", "step_hash", n)
    return windows.first_by(x, ["stmt_hash"], [F.desc("started_at"), F.desc("step_hash")]).drop("step_hash")


@query("SELECT stmt_hash, belief, row_number() OVER (ORDER BY belief DESC NULLS LAST, stmt_hash) AS row, count(*) OVER () AS total FROM statement_v QUALIFY row > 40 AND row <= 60")
def w7_page(s, d):
    x = windows.page(V.statement(s, d).select("stmt_hash", "belief"), [F.desc_nulls_last("belief"), F.col("stmt_hash")], 40, 20)
    return x.withColumn("row", F.col("row").cast("bigint"))


@query("SELECT stmt_hash, evidence_hash, row_number() OVER (PARTITION BY stmt_hash ORDER BY evidence_hash) - 1 AS evidence_index FROM membership_v")
def w10_ordinals(s, d):
    return V.membership(s, d).withColumn("evidence_index", (F.row_number().over(Window.partitionBy("stmt_hash").orderBy("evidence_hash")) - 1).cast("bigint"))


@query("SELECT m.stmt_hash, m.evidence_hash, e.source_api, s.stmt_type FROM membership_v m JOIN evidence_v e USING (evidence_hash) JOIN statement_v s USING (stmt_hash)")
def j2_bridge(s, d):
    return V.membership(s, d).join(V.evidence(s, d), "evidence_hash").join(V.statement(s, d), "stmt_hash").select("stmt_hash", "evidence_hash", "source_api", "stmt_type")


@query("SELECT m.stmt_hash, m.evidence_hash FROM membership_v m WHERE NOT EXISTS (SELECT 1 FROM step_v s WHERE s.run_id = 'run_O' AND s.stmt_hash = m.stmt_hash AND s.evidence_hash = m.evidence_hash)")
def j6_missing_steps(s, d):
    return V.membership(s, d).join(V.step(s, d).filter("run_id = 'run_O'"), ["stmt_hash", "evidence_hash"], "left_anti")


@query("""SELECT DISTINCT stmt_hash FROM membership_v m WHERE NOT EXISTS (SELECT 1 FROM membership_v x WHERE x.stmt_hash = m.stmt_hash AND NOT EXISTS
  (SELECT 1 FROM step_v s WHERE s.run_id = 'run_O' AND s.stmt_hash = x.stmt_hash AND s.evidence_hash = x.evidence_hash))""")
def j7_relational_division(s, d):
    return V.membership(s, d).select("stmt_hash").distinct().join(j6_missing_steps(s, d).select("stmt_hash").distinct(), "stmt_hash", "left_anti")


@query("SELECT stmt_hash, evidence_hash, probe, max(hit) AS captured FROM (SELECT e.stmt_hash, e.evidence_hash, p.probe, (t.step_kind IS NOT NULL)::INT AS hit FROM (SELECT DISTINCT stmt_hash, evidence_hash FROM trace_v) e CROSS JOIN (SELECT unnest(['subject_role_probe', 'object_role_probe', 'relation_axis_probe', 'scope_probe']) AS probe) p LEFT JOIN trace_v t ON t.stmt_hash = e.stmt_hash AND t.evidence_hash = e.evidence_hash AND t.step_kind = p.probe) GROUP BY 1, 2, 3")
def j10_densify(s, d):
    t = V.trace_step(s, d).groupBy("stmt_hash", "evidence_hash").agg(F.collect_set("step_kind").alias("kinds"))
    x = t.select("*", F.explode(F.array(*map(F.lit, V.KINDS[3:7]))).alias("probe"))
    return x.select("stmt_hash", "evidence_hash", "probe", F.array_contains("kinds", F.col("probe")).cast("int").alias("captured"))


@query("SELECT run_id, architecture, started_at, prior FROM (SELECT r.run_id, r.architecture, r.started_at, (SELECT arg_max(p.run_id, p.started_at) FROM run_v p WHERE p.architecture = r.architecture AND p.status = 'succeeded' AND p.started_at < r.started_at) AS prior FROM run_v r WHERE r.status = 'succeeded')")
def j15_predecessor_run(s, d):
    w = Window.partitionBy("architecture").orderBy("started_at")
    return V.run(s, d).filter("status = 'succeeded'").select("run_id", "architecture", "started_at", F.lag("run_id").over(w).alias("prior"))


@query(f", {_SCORES}, c AS (SELECT run_id, stmt_type, avg(abs(residual)) AS mae, avg(residual) AS bias FROM res GROUP BY 1, 2 HAVING count(*) >= 2) SELECT run_id, stmt_type, round(mae, 6) AS mae, round(bias, 6) AS bias FROM c")
def j17_metric_pivot(s, d):
    m = validity.metric_rows({"stratified": (validity.calibration(_res(s, d), ["run_id", "stmt_type"], 2), {"mae": "mae", "bias": "bias"}, ["stmt_type"])})
    x = m.select("run_id", F.get_json_object("slice_json", "$.stmt_type").alias("stmt_type"), F.substring_index("metric_name", ".", -1).alias("metric"), "value")
    return rounded(x.groupBy("run_id", "stmt_type").pivot("metric", ["mae", "bias"]).agg(F.first("value")))


@query("SELECT a.record_id, b.record_id AS other_id FROM fewshot_pool a JOIN fewshot_pool b ON least(lower(a.subject), lower(a.object)) = least(lower(b.subject), lower(b.object)) AND greatest(lower(a.subject), lower(a.object)) = greatest(lower(b.subject), lower(b.object)) WHERE a.subject IS NOT NULL AND a.object IS NOT NULL AND b.subject IS NOT NULL AND b.object IS NOT NULL AND a.record_id < b.record_id AND a.matches_hash <> b.matches_hash")
def j18_pair_lookup(s, d):
    p = table(s, d, "fewshot_pool").filter("subject is not null and object is not null").select("record_id", "matches_hash", F.array_sort(F.array(F.lower("subject"), F.lower("object"))).alias("pair"))
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.record_id") < F.col("b.record_id")) & (F.col("a.matches_hash") != F.col("b.matches_hash"))).select("a.record_id", F.col("b.record_id").alias("other_id"))


_PRIOR = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in belief.PRIORS.items()) + ") p(source, rand, syst))"
_N = f"n AS (SELECT stmt_hash, source_api, count(*) AS n, count(*) FILTER (is_curated) AS ok FROM membership_v JOIN evidence_v USING (evidence_hash) GROUP BY 1, 2), f AS (SELECT n.*, coalesce(rand, {belief.OTHER[0]}) AS rand, coalesce(syst, {belief.OTHER[1]}) AS syst FROM n LEFT JOIN {_PRIOR} p ON p.source = n.source_api)"


@query(f", {_N} SELECT stmt_hash, round(1 - product(syst + pow(rand, n)), 6) AS reliability FROM f GROUP BY 1")
def bel1_reliability(s, d):
    n = V.membership(s, d).join(V.evidence(s, d), "evidence_hash").groupBy("stmt_hash", F.col("source_api").alias("source")).agg(F.count("*").alias("n"))
    return rounded(belief.reliability(n, ["stmt_hash"]))


@query(f""", {_N}, u AS (SELECT stmt_hash, source_api, row_number() OVER (PARTITION BY stmt_hash ORDER BY source_api) AS i, count(*) OVER (PARTITION BY stmt_hash) AS k, sum(n) OVER (PARTITION BY stmt_hash) AS total, rand, syst FROM f)
  SELECT stmt_hash, round(1 - product(syst + pow(rand, CASE WHEN i = 1 THEN 1 + total - k ELSE 1 END)), 6) AS reliability FROM u GROUP BY 1""")
def bel2_spread_reliability(s, d):
    e = V.membership(s, d).join(V.evidence(s, d), "evidence_hash").groupBy("stmt_hash").agg(F.collect_set("source_api").alias("sources"), F.count("*").alias("total"))
    return rounded(belief.reliability(belief.spread(e, ["stmt_hash"]), ["stmt_hash"]))


@query(f", {_N} SELECT stmt_hash, round(1 - product(CASE WHEN ok = 0 THEN 1 ELSE syst + pow(rand, ok) END), 6) AS belief, round(1 - product(syst + pow(rand, n)), 6) AS parametric, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(ok) AS BIGINT) AS n_surviving FROM f GROUP BY 1")
def bel4_gated(s, d):
    e = V.membership(s, d).join(V.evidence(s, d), "evidence_hash").select("stmt_hash", F.col("source_api").alias("source"), F.col("is_curated").alias("included"))
    return rounded(belief.gated(e, ["stmt_hash"]).drop("per_source"))


_DIRECTED = f"""n AS (SELECT stmt_hash, verdict AS direction, source_api, count(*) AS n, count(*) FILTER ({{included}}) AS ok FROM step_v JOIN evidence_v USING (evidence_hash) GROUP BY 1, 2, 3),
  f2 AS (SELECT n.*, coalesce(rand, {belief.OTHER[0]}) AS rand, coalesce(syst, {belief.OTHER[1]}) AS syst FROM n LEFT JOIN {_PRIOR} p ON p.source = n.source_api)"""


@query(f""", {_DIRECTED.format(included="is_curated")}, r AS (SELECT stmt_hash, direction, 1 - product(CASE WHEN ok = 0 THEN 1 ELSE syst + pow(rand, ok) END) AS belief, 1 - product(syst + pow(rand, n)) AS parametric, sum(n) AS n, sum(ok) AS ok FROM f2 GROUP BY 1, 2),
  t AS (SELECT *, row_number() OVER (PARTITION BY stmt_hash ORDER BY round(belief, 12) DESC, direction) AS i FROM r)
  SELECT stmt_hash, round(max(belief) FILTER (i = 1) * (1 - coalesce(max(belief) FILTER (i > 1), 0)), 9) AS belief, round(max(parametric) FILTER (i = 1), 9) AS parametric, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(ok) AS BIGINT) AS n_surviving,
    max(direction) FILTER (i = 1) AS direction, count(*) > 1 AS contradictory FROM t GROUP BY 1""")
def bel5_gated_contradiction(s, d):
    e = V.step(s, d).join(V.evidence(s, d), "evidence_hash").select("stmt_hash", F.col("source_api").alias("source"), F.col("is_curated").alias("included"), F.col("verdict").alias("direction"))
    x = belief.gated_with_contradiction(e, ["stmt_hash"]).drop("per_source")
    return x.withColumns({c: F.round(c, 9) for c in ("belief", "parametric")})


@query(f""", m AS (SELECT stmt_hash, source_api, count(*) AS n, count(*) FILTER (verdict IN ('correct', 'abstain') OR verdict IS NULL) AS ok, bool_or(verdict IS NOT NULL) AS scored FROM step_v JOIN evidence_v USING (evidence_hash) GROUP BY 1, 2),
  f3 AS (SELECT m.*, coalesce(rand, {belief.OTHER[0]}) AS rand, coalesce(syst, {belief.OTHER[1]}) AS syst FROM m LEFT JOIN {_PRIOR} p ON p.source = m.source_api)
  SELECT stmt_hash, round(1 - product(CASE WHEN ok = 0 THEN 1 ELSE syst + pow(rand, ok) END), 6) AS belief, round(1 - product(syst + pow(rand, n)), 6) AS parametric, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(ok) AS BIGINT) AS n_surviving,
    CAST(sum(n) - sum(ok) AS BIGINT) AS n_gated, bool_or(scored) AS has_scores FROM f3 GROUP BY 1""")
def bel7_composed(s, d):
    e = V.step(s, d).join(V.evidence(s, d), "evidence_hash").select("stmt_hash", F.col("source_api").alias("source"), "verdict")
    return rounded(belief.composed(e, ["stmt_hash"]).drop("per_source"))


@query(f", {_N} SELECT stmt_hash, source_api AS source, n, ok AS surviving, CASE WHEN ok > 0 THEN round(syst + pow(rand, ok), 6) END AS doubt FROM f")
def bel4_breakdown(s, d):
    e = V.membership(s, d).join(V.evidence(s, d), "evidence_hash").select("stmt_hash", F.col("source_api").alias("source"), F.col("is_curated").alias("included"))
    return rounded(belief.gated(e, ["stmt_hash"]).select("stmt_hash", F.explode("per_source").alias("p")).select("stmt_hash", "p.*"))


@query(f""", n AS (SELECT stmt_hash, verdict AS direction, source_api, count(*) AS n FROM step_v JOIN evidence_v USING (evidence_hash) GROUP BY 1, 2, 3),
  r AS (SELECT stmt_hash, direction, 1 - product(coalesce(syst, {belief.OTHER[1]}) + pow(coalesce(rand, {belief.OTHER[0]}), n)) AS rel FROM n LEFT JOIN {_PRIOR} p ON p.source = n.source_api GROUP BY 1, 2),
  t AS (SELECT *, row_number() OVER (PARTITION BY stmt_hash ORDER BY round(rel, 12) DESC, direction) AS i FROM r)
  SELECT a.stmt_hash, round(any_value(a.rel) * (1 - coalesce(max(b.rel), 0)), 9) AS reliability, any_value(a.direction) AS direction, max(b.rel) IS NOT NULL AS contradictory
  FROM t a LEFT JOIN t b ON b.stmt_hash = a.stmt_hash AND b.i > 1 WHERE a.i = 1 GROUP BY 1""")
def bel3_contradiction(s, d):
    n = V.step(s, d).join(V.evidence(s, d), "evidence_hash").groupBy("stmt_hash", F.col("verdict").alias("direction"), F.col("source_api").alias("source")).agg(F.count("*").alias("n"))
    r = belief.reliability(n, ["stmt_hash", "direction"]).withColumn("reliability", F.round("reliability", 12))
    return belief.contradiction(r, ["stmt_hash"]).withColumn("reliability", F.round("reliability", 9))
