"""Belief, validity, windows, cohorts, traces, paired runs, evaluation and ingest on small fixtures."""

import json
import math
from itertools import product
from math import comb

import pytest
from pyspark.sql import functions as F

from proofloom.functions import scalars
from proofloom.operators import belief, cohorts, evaluation, ingest, paired, trace, validity, windows
from tests.conftest import rows


def test_known_reliabilities(spark):
    data = [("a", "reach", 1), ("b", "reach", 2), ("c", "signor", 1), ("d", "reach", 1), ("d", "signor", 1), ("e", "nobody", 1), ("f", "reach", 0), ("g", "Reach", 1)]
    got = {r[0]: r[1] for r in belief.reliability(spark.createDataFrame(data, "k string, source string, n int"), ["k"]).collect()}
    want = {"a": 0.65, "b": 0.86, "c": 0.941, "d": 0.97935, "e": 0.60, "f": 0.0, "g": 0.65}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_spread_gives_the_rest_to_the_first_source(spark):
    e = spark.createDataFrame([("a", ["z", "b", "z"], 5), ("c", ["x"], 3), ("d", [], 2), ("e", ["x"], 0)], "k string, sources array<string>, total int")
    assert rows(belief.spread(e, ["k"])) == [("a", "b", 4), ("a", "z", 1), ("c", "x", 3)]


def test_gated_sources_drop_out(spark):
    ev = spark.createDataFrame([("a", "reach", False), ("a", "Signor", True), ("b", "reach", False), ("c", "reach", None)], "k string, source string, included boolean")
    got = {r["k"]: (round(r["belief"], 6), round(r["parametric"], 6), r["n_surviving"]) for r in belief.gated(ev, ["k"]).collect()}
    assert got == {"a": (0.941, 0.97935, 1), "b": (0.0, 0.65, 0), "c": (0.65, 0.65, 1)}
    with pytest.raises(Exception, match="without a source"):
        belief.gated(spark.createDataFrame([("a", None, True)], "k string, source string, included boolean"), ["k"]).collect()


def test_contradiction(spark):
    d = spark.createDataFrame([("a", "up", 0.8), ("a", "down", 0.5), ("b", "up", 0.8), ("b", "unknown", 0.7), ("c", "up", 0.5), ("c", "down", 0.5)], "k string, direction string, reliability double")
    assert rows(belief.contradiction(d, ["k"])) == [("a", 0.4, "up", True), ("b", 0.8, "up", False), ("c", 0.25, "down", True)]


def test_noisy_or_ignores_nulls(spark):
    x = spark.createDataFrame([("a", 0.5), ("a", 0.2), ("a", None), ("b", None), ("c", 1.5)], "k string, s double")
    assert rows(x.groupBy("k").agg(F.round(belief.noisy_or(F.col("s")), 9)).na.fill(-1.0)) == [("a", 0.6), ("b", -1.0), ("c", 1.0)]


def test_gold_precedence(spark):
    steps = spark.createDataFrame([("r", "s1", "e1", "h1", "correct"), ("r", "s2", "e1", "h2", "correct"), ("r", "s1", "e9", "h3", "correct")], "run_id string, stmt_hash string, evidence_hash string, step_hash string, verdict string")
    labels = spark.createDataFrame([("e1", None, "tag", "x"), ("e1", None, "verdict", "y"), ("e1", "s1", "tag", "z"), ("e1", "s7", "verdict", "w")], "target_id string, relation_target_id string, field string, value_text string")
    got = windows.gold(labels, steps).select("step_hash", "gold", "gold_field")
    assert rows(got) == [("h1", "z", "tag"), ("h2", "y", "verdict")]


def test_confusion_of_three_and_undefined_measures(spark):
    x = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, True), ("a", None, True), ("b", False, False)], "k string, p boolean, t boolean")
    got = {r["k"]: r.asDict() for r in validity.confusion(x, ["k"], F.col("p"), F.col("t")).collect()}
    assert (got["a"]["tp"], got["a"]["fp"], got["a"]["fn"], got["a"]["precision"], got["a"]["f1"]) == (1, 1, 1, 0.5, 0.5)
    assert (got["b"]["precision"], got["b"]["recall"], got["b"]["f1"], got["b"]["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_verdict_lattice(spark):
    data = [("a", "correct"), ("a", "incorrect"), ("b", "correct"), ("b", "abstain"), ("c", "correct"), ("d", "correct"), ("d", None), ("e", None)]
    got = validity.verdict_lattice(spark.createDataFrame(data, "k string, verdict string"), ["k"]).select("k", "stmt_verdict")
    assert rows(got) == [("a", "incorrect"), ("b", "abstain"), ("c", "correct"), ("d", "mixed"), ("e", "unknown")]


def test_supports_delta_of_one_bucket_is_nan(spark):
    s = spark.createDataFrame([("r", "a", 0.5, 1)], "run_id string, stmt_hash string, our_score double, n int")
    st = spark.createDataFrame([("a", True)], "stmt_hash string, has_supports boolean")
    r = validity.supports_delta(s, st).first()
    assert math.isnan(r["delta"]) and r["unavailable_reason"]


def test_pages_clamp(spark):
    x = spark.range(45)
    assert [r["row"] for r in windows.page(x, [F.col("id")], 500, 20).collect()] == [41, 42, 43, 44, 45]
    assert windows.page(x.limit(0), [F.col("id")], 0, 20).count() == 0


def test_cohort_contract_and_diagnostics(spark):
    for bad in ({"colour": "x"}, {"supports": "maybe"}, {"trace_fidelity": "none"}):
        with pytest.raises(ValueError):
            cohorts.predicates(bad)
    assert cohorts.checked({"verdict": "", "supports": False, "score_present": "1"}) == {"score_present": True}
    steps = spark.createDataFrame([("r", "s", "e", "h", 0.5, "correct", "low")], "run_id string, stmt_hash string, evidence_hash string, step_hash string, score double, verdict string, confidence string")
    st = spark.createDataFrame([("s", "T", 0.1, True)], "stmt_hash string, stmt_type string, belief double, has_supports boolean")
    base = cohorts.cohort_rows(steps, st, spark.createDataFrame([("e", "reach")], "evidence_hash string, source_api string"))
    reason = lambda run, f: {r["filter"]: r["reason"] for r in cohorts.diagnostics(base, run, f).collect()}
    assert reason("q", {"verdict": "correct"}) == {"verdict": "empty_run"}
    assert reason("r", {"verdict": "abstain", "confidence": "low"}) == {"verdict": "absent_in_run", "confidence": "no_intersection"}
    assert reason("r", {}) == {"none": None}
    assert cohorts.evidence_cohort(base, "r", {"trace_fidelity": "aggregate_only"}).count() == 1


def test_trace_states(spark):
    def step(ev, kind, error=None):
        return ("r", "s", ev, kind, f"{ev}{kind}", "2031-01-01", 1, 0.5, "correct", error)

    full = [step("full", k) for k in (*trace.EXPECTED, "aggregate")]
    data = [*full, step("partial", "grounding"), step("partial", "aggregate"), step("bare", "aggregate"), step("none", "grounding"), step("bad", "aggregate"), step("bad", "grounding", "x")]
    df = spark.createDataFrame(data, "run_id string, stmt_hash string, evidence_hash string, step_kind string, step_hash string, started_at string, latency_ms int, score double, verdict string, error string")
    got = lambda status: {r["evidence_hash"]: r["trace_state"] for r in trace.trace_states(df, F.lit(status)).collect()}
    assert got("succeeded") == {"full": "full", "partial": "partial", "bare": "aggregate_only", "none": "missing_aggregate", "bad": "step_error"}
    assert got("running")["none"] == "terminated_inflight"
    assert trace.trace_states(df, F.lit("x")).filter("evidence_hash = 'bad'").first()["representative"] == "badgrounding"


def test_paired_arms_use_the_newest_step(spark):
    cols = "run_id string, stmt_hash string, evidence_hash string, step_hash string, score double, verdict string, confidence string, latency_ms int, started_at timestamp, error string"
    base = spark.createDataFrame([("a", "s", "e", "1", 0.1, "correct", "low", 1, None, ""), ("b", "s", "e", "3", 0.9, "abstain", "low", 1, None, None), ("b", "s", "f", "4", 0.9, "abstain", "low", 1, None, "x")], cols)
    newer = base.filter("run_id = 'a'").withColumn("step_hash", F.lit("2")).withColumn("score", F.lit(0.4)).withColumn("started_at", F.to_timestamp(F.lit("2031-01-01")))
    steps = base.unionByName(newer)
    assert rows(paired.overlap(steps, "a", "b").select("a_score", "b_score")) == [(0.4, 0.9)]
    assert rows(paired.integrity(steps, "a", "b")) == [("a", 2, 1, 0, 1, 0, 1), ("b", 2, 2, 1, 0, 1, 1)]


def test_mcnemar_known_answers():
    assert round(evaluation.mcnemar(60, 37), 4) == 0.0250
    assert evaluation.mcnemar(0, 0) == 1.0 and evaluation.mcnemar(5, 5) == 1.0
    assert evaluation.mcnemar(9, 1) == 2 * (comb(10, 9) + comb(10, 10)) / 2**10


def test_average_precision_and_bins_with_ties(spark):
    x = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0), (None, 1), (1.0, 1)], "s double, t int")
    ap = evaluation.average_precision(x, F.col("s"), F.col("t")).first()[0]
    assert math.isclose(ap, (1 * 1 / 1 + 1 * 2 / 3 + 1 * 3 / 4) / 3)
    b = evaluation.reliability_bins(x, F.col("s"), F.col("t") == 1, [0.0, 0.5, 1.0])
    assert rows(b.select("bin", "n")) == [(0, 1), (1, 3)]
    assert evaluation.average_precision(x.filter("s > 5"), F.col("s"), F.col("t")).first()[0] is None


def test_contamination_kinds(spark):
    long = "the quick brown fox jumps over the lazy dog while the small cat sleeps in the warm afternoon sun"
    ex = spark.createDataFrame([(1, f"{long}."), (2, long[10:60]), (3, f"Start differs here {long[20:]} and then it goes on"), (4, "short"), (5, None), (6, "")], "id long, text string")
    ev = spark.createDataFrame([(9, long.upper()), (8, "nothing in common with the others at all, but long enough"), (7, None)], "id long, text string")
    assert rows(evaluation.contamination(ex, ev)) == [(1, 9, "exact"), (2, 9, "contained"), (3, 9, "shingle")]


DOCS = [
    {"type": "Phosphorylation", "id": "u1", "matches_hash": "-7741665252118712766", "enz": {"name": "A"}, "sub": None, "belief": 0, "supports": ["u2", "u9"], "evidence": [{"source_api": "reach", "source_hash": 5, "epistemics": {"direct": True}}, {"source_api": "x", "text": "t"}]},
    {"type": "Complex", "id": "u2", "matches_hash": "12", "members": [None, {"name": "B"}], "belief": 0.3, "evidence": [{"source_hash": 5}]},
    {"type": "Other", "id": "u3", "matches_hash": "13", "agent": {"name": "C"}},
]


def test_ingest(spark):
    raw = [(json.dumps(d),) for d in DOCS] + [("{broken",), ("",), (None,), ("[1]",)]
    docs = ingest.parsed(spark.createDataFrame(raw, "raw_json string"))
    assert rows(ingest.statements(docs).select("stmt_hash", "belief", "supports_count")) == [("000000000000000c", 0.3, 0), ("000000000000000d", 1.0, 0), ("94901478657aae42", 1.0, 2)]
    m = ingest.memberships(docs)
    assert m.count() == 3 and m.filter("evidence_hash = '0000000000000005'").count() == 2
    assert rows(ingest.agents(docs)) == [("000000000000000c", "member", 1, "B"), ("000000000000000d", "agent", 0, "C"), ("94901478657aae42", "enz", 0, "A")]
    assert rows(ingest.edges(docs)) == [("94901478657aae42", "000000000000000c", "supports"), ("94901478657aae42", "u9", "supports")]
    assert ingest.labels(docs).filter("field = 'direct'").count() == 1
    assert ingest.repeated(m).count() == 0
    assert rows(ingest.conflicts(m, m.filter("evidence_index = 0")).select("old_n", "new_n")) == [(2, 1)]


def test_scalar_functions(spark):
    x = spark.createDataFrame([("correct", None, "TGF-β1", "p53 binds", "p53"), ("none", "high", None, "ap53x", "p53"), (None, None, "", None, "ABCDE")], "v string, c string, a string, t string, s string")
    got = x.select(scalars.score_of(F.col("v"), F.col("c")), scalars.plain_alias(F.col("a")), scalars.mentions(F.col("t"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(0.8, "tgfbeta1", True), (0.5, None, False), (0.5, "", None)]
    y = spark.createDataFrame([('x {"verdict": "abstain"} y {"verdict" : "correct"}',), ("none",), (None,)], "t string")
    assert [r[0] for r in y.select(scalars.last_verdict(F.col("t"))).collect()] == ["correct", None, None]


def test_score_grid_is_complete(spark):
    grid = [(v, c) for v, c in product(("correct", "incorrect"), ("low", "medium", "high"))]
    got = {tuple(r)[:2]: r[2] for r in spark.createDataFrame(grid, "v string, c string").select("v", "c", scalars.score_of(F.col("v"), F.col("c"))).collect()}
    assert got == scalars.SCORES


def test_gated_belief_by_direction(spark):
    data = [("a", "reach", True, "up"), ("a", "Reach", True, "up"), ("a", "signor", False, "up"), ("a", "reach", True, "down"), ("b", "reach", None, None), ("b", "reach", True, "up"), ("c", "reach", False, "up")]
    df = spark.createDataFrame(data, "k string, source string, included boolean, direction string")
    got = {r["k"]: r for r in belief.gated_with_contradiction(df, ["k"]).collect()}
    up, down = 1 - (0.05 + 0.3**2), 1 - (0.05 + 0.3)
    assert abs(got["a"]["belief"] - up * (1 - down)) < 1e-12 and got["a"]["direction"] == "up" and got["a"]["contradictory"]
    assert (got["a"]["n_total"], got["a"]["n_surviving"]) == (4, 3)
    assert [(p["source"], p["n"], p["surviving"]) for p in got["a"]["per_source"]] == [("reach", 2, 2), ("signor", 1, 0)]
    assert got["b"]["direction"] == "unknown" and got["b"]["contradictory"] and got["c"]["belief"] == 0.0 and not got["c"]["contradictory"]
    assert belief.gated_with_contradiction(df.limit(0), ["k"]).count() == 0


def test_composed_belief_from_verdicts(spark):
    data = [("a", "reach", "correct", "up"), ("a", "reach", "Incorrect", "up"), ("a", None, "abstain", "down"), ("b", "reach", None, "up")]
    df = spark.createDataFrame(data, "k string, source string, verdict string, direction string")
    got = {r["k"]: r for r in belief.composed(df, ["k"]).collect()}
    assert (got["a"]["n_total"], got["a"]["n_surviving"], got["a"]["n_gated"], got["a"]["has_scores"]) == (3, 2, 1, True)
    assert not got["b"]["has_scores"] and got["b"]["n_gated"] == 0
    strict = {r["k"]: r["n_surviving"] for r in belief.composed(df, ["k"], gate_unscored=True, directions=True).collect()}
    assert strict == {"a": 1, "b": 0}
    assert belief.RECALIBRATED["signor"] == belief.PRIORS["signor"] and belief.RECALIBRATED["reach"] != belief.PRIORS["reach"]


def test_mcnemar_in_logarithms(monkeypatch):
    for b, c in ((620, 500), (700, 300), (505, 505), (1000, 0)):
        exact = min(1.0, 2 * sum(comb(b + c, i) for i in range(max(b, c), b + c + 1)) / 2 ** (b + c))
        monkeypatch.setattr(evaluation, "EXACT_PAIRS", 0)
        assert abs(evaluation.mcnemar(b, c) - exact) <= 1e-9 * exact + 1e-300
    assert evaluation.mcnemar(1_000_000, 998_000) > 0.1
