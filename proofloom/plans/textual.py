"""Queries of text rules, lookups and further read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.functions import catalog, siterules, textrules
from proofloom.operators import belief, evaluation, ingest, validity, windows
from proofloom.plans import audit
from proofloom.plans import views as V
from proofloom.sources.tables import table

#: Rows of the stratified sample.
SAMPLE_SIZE = 500
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: bool = False):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (V.SQL if views else "") + sql
        return f

    return put


@query(r"SELECT record_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(evidence_text, '\b((?:Ser|Thr|Tyr|Lys)-?\d{1,4})\b', 1), lambda s: replace(s, '-', '')))), ' ') AS sites FROM fewshot_pool WHERE regexp_matches(evidence_text, '\b((?:Ser|Thr|Tyr|Lys)-?\d{1,4})\b')")
def c12_sites(s, d):
    x = table(s, d, "fewshot_pool").select("record_id", siterules.sites(F.col("evidence_text")).alias("sites"))
    return x.filter(F.size("sites") > 0).withColumn("sites", F.array_join(F.array_sort("sites"), " "))


@query(rf"SELECT source_api, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), '\b(?:{'|'.join(textrules.HEDGES)})\b')) AS hedged FROM evidence WHERE text IS NOT NULL GROUP BY 1")
def c14_hedges(s, d):
    x = table(s, d, "evidence").filter("text is not null")
    return x.groupBy("source_api").agg(F.count("*").alias("n"), F.count_if(textrules.hedged(F.col("text"))).alias("hedged"))


@query(r"SELECT DISTINCT evidence_hash, w AS noun FROM (SELECT evidence_hash, unnest(regexp_extract_all(lower(text), '(?:^|[ (])([a-z]{4,}(?:at|it)ion) of ', 1)) AS w FROM evidence)")
def c18_nominalizations(s, d):
    x = table(s, d, "evidence").select("evidence_hash", F.explode(textrules.nominalizations(F.col("text"))).alias("noun"))
    return x.distinct()


@query()
def c16_mediators(s, d):
    return table(s, d, "evidence").select("evidence_hash", F.explode(textrules.mediators(F.col("text"))).alias("mediator")).distinct()


_REL = " UNION ALL ".join(f"SELECT evidence_hash, '{n}' AS relation, {sg} AS sign, unnest(regexp_extract_all(text, '{p}', {a})) AS agent, unnest(regexp_extract_all(text, '{p}', {b})) AS target FROM evidence" for n, sg, p, a, b in textrules.CATALOG)


@query(f"SELECT DISTINCT evidence_hash, relation, sign, agent, target FROM ({_REL}) WHERE agent <> target")
def c10_relations(s, d):
    """All patterns of the catalog; the SQL has only the nine sentence forms, whose rows are among these."""
    return catalog.relations(table(s, d, "evidence"), "evidence_hash", "text").distinct()


@query(f"WITH r AS (SELECT DISTINCT evidence_hash, relation, agent, target FROM ({_REL}) WHERE agent <> target), n AS (SELECT name AS alias, arg_min(agent_hash, (role_index, agent_hash)) AS canonical FROM agent WHERE name IS NOT NULL GROUP BY 1) SELECT evidence_hash, relation, a.canonical AS agent_id, b.canonical AS target_id FROM r JOIN n a ON a.alias = r.agent JOIN n b ON b.alias = r.target WHERE a.canonical <> b.canonical")
def c11_bound_relations(s, d):
    """The same with both names bound; the SQL has only the nine sentence forms, whose rows are among these."""
    r = catalog.relations(table(s, d, "evidence"), "evidence_hash", "text").distinct()
    names = table(s, d, "agent").filter("name is not null").select(F.col("name").alias("alias"), F.col("agent_hash").alias("canonical"), F.col("role_index").alias("position"))
    return textrules.bound(r, names).select("evidence_hash", "relation", "axis", "sign", "agent_id", "target_id", "site").distinct()


@query("SELECT run_id, stmt_hash, count(*) AS steps FROM step_v WHERE stmt_hash IN (SELECT stmt_hash FROM statement_v WHERE belief > 0.9) GROUP BY 1, 2", views=True)
def j14_available_runs(s, d):
    st = V.statement(s, d).filter("belief > 0.9")
    return V.step(s, d).join(st, "stmt_hash", "left_semi").groupBy("run_id", "stmt_hash").agg(F.count("*").alias("steps"))


@query("SELECT 'statement' AS kind, stmt_hash AS id FROM statement_v WHERE stmt_hash IN (SELECT relation_target_id FROM truth_label_v) UNION ALL SELECT 'evidence', evidence_hash FROM evidence_v WHERE evidence_hash IN (SELECT target_id FROM truth_label_v)", views=True)
def j12_labelled(s, d):
    lab = V.truth_label(s, d)
    a = V.statement(s, d).join(lab.select(F.col("relation_target_id").alias("stmt_hash")), "stmt_hash", "left_semi").select(F.lit("statement").alias("kind"), F.col("stmt_hash").alias("id"))
    b = V.evidence(s, d).join(lab.select(F.col("target_id").alias("evidence_hash")), "evidence_hash", "left_semi").select(F.lit("evidence").alias("kind"), F.col("evidence_hash").alias("id"))
    return a.unionByName(b)


_HEX = "lpad(lower(to_hex(CAST(source_hash AS BIGINT))), 16, '0')"


@query(f"SELECT p.record_id, e.evidence_hash, e.source_api, count(DISTINCT m.stmt_hash) AS statements FROM fewshot_pool p JOIN evidence e ON e.evidence_hash = {_HEX.replace('source_hash', 'p.source_hash')} LEFT JOIN statement_evidence m ON lower(trim(m.evidence_hash)) = e.evidence_hash GROUP BY 1, 2, 3")
def e1_curation_join(s, d):
    p = table(s, d, "fewshot_pool").select("record_id", ingest.hex16(F.col("source_hash")).alias("evidence_hash"))
    m = table(s, d, "statement_evidence").select(F.lower(F.trim("evidence_hash")).alias("evidence_hash"), "stmt_hash").groupBy("evidence_hash").agg(F.countDistinct("stmt_hash").alias("statements"))
    e = table(s, d, "evidence").select("evidence_hash", "source_api").distinct()
    return p.join(e, "evidence_hash").join(m, "evidence_hash", "left").na.fill(0, ["statements"]).select("record_id", "evidence_hash", "source_api", "statements")


_PR = audit._PRIOR
_GATE = f"""WITH c AS (SELECT record_id, tag, source_api, unnest(map_keys(source_counts)) AS source, unnest(map_values(source_counts)) AS n FROM fewshot_pool WHERE tag IS NOT NULL),
  g AS (SELECT record_id, source, n, CASE WHEN lower(trim(tag)) <> 'correct' AND lower(trim(source_api)) = source THEN n - 1 ELSE n END AS k FROM c)
  SELECT record_id, round(1 - coalesce(product(coalesce(syst, {belief.OTHER[1]}) + pow(coalesce(rand, {belief.OTHER[0]}), n)), 1), 6) AS parametric,
  round(1 - coalesce(product(coalesce(syst, {belief.OTHER[1]}) + pow(coalesce(rand, {belief.OTHER[0]}), k)) FILTER (k > 0), 1), 6) AS gated FROM g LEFT JOIN {_PR} p USING (source) GROUP BY 1"""


@query(_GATE)
def e10_gate_simulation(s, d):
    """Reliability of every curated record, and the same with an incorrect evidence taken from its source's count."""
    p = table(s, d, "fewshot_pool").filter("tag is not null")
    long = p.select("record_id", "tag", "source_api", F.explode("source_counts").alias("source", "n"))
    hit = (F.lower(F.trim("tag")) != "correct") & (F.lower(F.trim("source_api")) == F.col("source"))
    k = F.when(F.coalesce(hit, F.lit(False)), F.col("n") - 1).otherwise(F.col("n"))
    a = belief.reliability(long, ["record_id"]).withColumnRenamed("reliability", "parametric")
    b = belief.reliability(long.withColumn("n", k), ["record_id"]).withColumnRenamed("reliability", "gated")
    return audit.rounded(a.join(b, "record_id"))


@query("SELECT lower(trim(source_api)) AS source, lower(trim(stmt_type)) AS kind, count(*) AS n, count(*) FILTER (lower(trim(tag)) = 'correct') AS correct, round(avg(belief), 6) AS mean_belief, round(avg(pow(belief - (lower(trim(tag)) = 'correct')::INT, 2)), 6) AS brier FROM fewshot_pool WHERE tag IS NOT NULL AND belief IS NOT NULL GROUP BY 1, 2")
def e18_error_profile(s, d):
    p = table(s, d, "fewshot_pool").filter("tag is not null and belief is not null").withColumns({"source": F.lower(F.trim("source_api")), "kind": F.lower(F.trim("stmt_type")), "ok": F.lower(F.trim("tag")) == "correct"})
    x = p.groupBy("source", "kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"), F.avg("belief").alias("mean_belief"), F.avg(F.pow(F.col("belief") - F.col("ok").cast("double"), 2)).alias("brier"))
    return audit.rounded(x)


@query("SELECT a.verdict AS before, b.verdict AS after, count(*) AS n FROM (SELECT evidence_hash, arg_max(verdict, (started_at, step_hash)) AS verdict FROM step_v WHERE run_id = 'run_F' GROUP BY 1) a JOIN (SELECT evidence_hash, arg_max(verdict, (started_at, step_hash)) AS verdict FROM step_v WHERE run_id = 'run_O' GROUP BY 1) b USING (evidence_hash) GROUP BY 1, 2", views=True)
def e15_flips(s, d):
    x = windows.latest(V.step(s, d).select("run_id", "evidence_hash", "verdict", "started_at", "step_hash"), ["run_id", "evidence_hash"])
    a = x.filter("run_id = 'run_F'").select("evidence_hash", F.col("verdict").alias("before"))
    b = x.filter("run_id = 'run_O'").select("evidence_hash", F.col("verdict").alias("after"))
    return a.join(b, "evidence_hash").groupBy("before", "after").agg(F.count("*").alias("n"))


@query(f", {audit._SCORES} SELECT * FROM (SELECT run_id, stmt_hash, round(residual, 9) AS residual, n_evidence FROM res QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY abs(round(residual, 9)) DESC, stmt_hash) = 1)", views=True)
def t13_focus_statement(s, d):
    x = audit._res(s, d).withColumn("residual", F.round("residual", 9))
    return windows.first_by(x, ["run_id"], [F.desc(F.abs("residual")), F.col("stmt_hash")]).select("run_id", "stmt_hash", "residual", "n_evidence")


@query(f""", sc AS (SELECT run_id, stmt_hash, count(*) AS n, stddev_pop(score) AS sd, avg(score) AS m FROM step_v WHERE score IS NOT NULL GROUP BY 1, 2), lo AS (SELECT * FROM sc WHERE n >= 3 AND round(m, 9) BETWEEN 0.4 AND 0.6)
  SELECT run_id, count(*) AS low_confidence, round(max(sd), 6) AS widest FROM lo GROUP BY 1""", views=True)
def t15_uncertain_statements(s, d):
    x = V.step(s, d).filter("score is not null").groupBy("run_id", "stmt_hash").agg(F.count("*").alias("n"), F.stddev_pop("score").alias("sd"), F.round(F.avg("score"), 9).alias("m"))
    return audit.rounded(x.filter("n >= 3 and m between 0.4 and 0.6").groupBy("run_id").agg(F.count("*").alias("low_confidence"), F.max("sd").alias("widest")))


@query("SELECT id, cls FROM (SELECT record_id AS id, lower(trim(stmt_type)) AS cls, pmid FROM fewshot_pool WHERE stmt_type IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY cls ORDER BY id) <= 35")
def e11_type_capped_sample(s, d):
    """500 records, no type over 35 %, tags with their least numbers; the SQL has the first 35 records of every type."""
    tag = F.regexp_replace(F.lower(F.trim("tag")), r"[\s-]+", "_")
    p = table(s, d, "fewshot_pool").select(F.col("record_id").alias("id"), F.lower(F.trim("stmt_type")).alias("cls"), tag.alias("tag"))
    return evaluation.stratified_sample(p, SAMPLE_SIZE).select("id", "cls")


@query("SELECT s.run_id, sum((verdict = gold)::INT) AS agree, count(*) AS n FROM (SELECT run_id, evidence_hash, stmt_hash, verdict FROM step_v) s JOIN (SELECT target_id AS evidence_hash, min(value_text) AS gold FROM truth_label_v WHERE relation_target_id IS NULL GROUP BY 1) g USING (evidence_hash) GROUP BY 1", views=True)
def e9_generic_agreement(s, d):
    g = V.truth_label(s, d).filter("relation_target_id is null").groupBy(F.col("target_id").alias("evidence_hash")).agg(F.min("value_text").alias("gold"))
    x = V.step(s, d).join(g, "evidence_hash").groupBy("run_id").agg(F.sum((F.col("verdict") == F.col("gold")).cast("bigint")).alias("agree"), F.count("*").alias("n"))
    return x


@query("SELECT stmt_type, count(*) AS n, count(belief) AS with_belief, count(*) FILTER (has_supports) AS supported, round(avg(belief), 6) AS mean_belief FROM statement_v GROUP BY 1 ORDER BY n DESC, stmt_type LIMIT 32", views=True)
def t1_top_types(s, d):
    x = V.statement(s, d).groupBy("stmt_type").agg(F.count("*").alias("n"), F.count("belief").alias("with_belief"), F.count_if("has_supports").alias("supported"), F.avg("belief").alias("mean_belief"))
    return audit.rounded(x.orderBy(F.desc("n"), "stmt_type").limit(32))


@query("SELECT verdict, confidence, round(share, 6) AS share FROM (SELECT verdict, confidence, count(*) / sum(count(*)) OVER () AS share FROM step_v WHERE run_id = 'run_O' GROUP BY 1, 2)", views=True)
def a5_joint_shares(s, d):
    x = V.step(s, d).filter("run_id = 'run_O'").withColumn("v", F.concat_ws("|", "verdict", "confidence"))
    y = validity.shares(x, "v").select(F.split("v", r"\|").alias("p"), F.round("share", 6).alias("share"))
    return y.select(F.col("p")[0].alias("verdict"), F.col("p")[1].alias("confidence"), "share")
