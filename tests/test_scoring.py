"""Scoring by a client, gates, aggregators, labels and guarded migrations."""

import math

import pytest
from pyspark.sql import functions as F

from proofloom.operators import ingest, scoring, trace
from tests.conftest import rows

PAIRS = "stmt_hash string, evidence_hash string, claim string, text string"


class Failing:
    def score(self, claim, text):
        if "bad" in text:
            raise RuntimeError("no answer")
        return {"score": 1, "verdict": "correct", "confidence": "high"}


def test_scored_pairs_and_failures(spark):
    df = spark.createDataFrame([("s", "e1", "AB1 binds CD2", "ab1 meets CD2"), ("s", "e2", "AB1 binds CD2", "AB1 only"), ("s", "e3", None, None), ("s", "e4", "AB1", "x" * 100_000)], PAIRS)
    assert rows(scoring.scored(df, scoring.RuleClient).select("evidence_hash", "verdict")) == [("e1", "correct"), ("e2", "incorrect"), ("e3", "abstain"), ("e4", "incorrect")]
    bad = spark.createDataFrame([("s", "e", "c", "bad"), ("s", "f", "c", "good")], PAIRS)
    got = {r["evidence_hash"]: r for r in scoring.scored(bad, Failing).collect()}
    assert got["e"]["score"] is None and got["e"]["verdict"] == "abstain" and "no answer" in got["e"]["error"] and got["f"]["score"] == 1.0
    assert scoring.scored(df.limit(0), scoring.RuleClient).count() == 0


def test_a_run_resumes_and_appends_nothing_twice(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([("s", "e1", "A1", "A1"), ("s", "e1", "A1", "A1"), ("s", "e2", "A1", "B")], PAIRS)
    assert scoring.score_corpus(df.filter("evidence_hash = 'e1'"), scoring.RuleClient, "r", "v1", log) == 1
    assert scoring.score_corpus(df, scoring.RuleClient, "r", "v1", log) == 1
    assert scoring.score_corpus(df, scoring.RuleClient, "r", "v1", log) == 0
    assert scoring.score_corpus(df, scoring.RuleClient, "r2", "v1", log) == 2


def test_last_json(spark):
    df = spark.createDataFrame([('a {"x": 1} b {"y": {"z": 2}} c',), ("{broken {\"k\": 0}",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(scoring.last_json(F.col("t"))).collect()] == ['{"y": {"z": 2}}', '{"k": 0}', None, None]


def test_gate(spark):
    df = spark.createDataFrame([("Correct",), ("incorrect",), ("abstain",), (None,)], "v string")
    assert [tuple(r) for r in df.select(scoring.passes_gate(F.col("v")), scoring.passes_gate(F.col("v"), True)).collect()] == [(True, True), (False, False), (True, False), (True, False)]


def test_aggregators(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.2), ("a", None)], "k string, score double")
    got = {h if isinstance(h, str) else "own": scoring.aggregated(df, ["k"], h).first()["score"] for h in ("mean", "noisy_or", max)}
    assert math.isclose(got["mean"], 0.35) and math.isclose(got["noisy_or"], 0.6) and got["own"] == 0.5
    with pytest.raises(ValueError):
        scoring.aggregated(df, ["k"], "median")


def test_checked_labels(spark):
    new = spark.createDataFrame([("t1", "verdict", "a", 1), ("t1", "verdict", "b", 2), (None, "verdict", "a", 1), ("t2", "", "a", 1), ("t9", "tag", "x", 1)], "target_id string, field string, value_text string, n int")
    known = spark.createDataFrame([("t1",), ("t2",)], "target_id string")
    kept, said = ingest.checked_labels(new, known, ["target_id", "field"])
    assert rows(kept.select("target_id", "value_text", "n")) == [("t1", "b", 2), ("t9", "x", 1)]
    assert said == {"rows": 5, "no_target": 1, "no_field": 1, "kept": 2, "unknown_targets": 1}


def test_migrations(spark):
    df = spark.createDataFrame([("s", "e1", '{"m": "x"}', ""), ("s", "e2", '{"m": "y"}', "own")], "stmt_hash string, evidence_hash string, j string, model string")
    assert rows(ingest.backfilled(df, "j", {"model": "$.m", "new": "$.m"}).select("model", "new")) == [("own", "y"), ("x", "x")]
    assert "evidence_hash" not in ingest.dropped_when_covered(df, "evidence_hash", ["stmt_hash"], df.select("stmt_hash", "evidence_hash")).columns
    with pytest.raises(ValueError):
        ingest.dropped_when_covered(df, "evidence_hash", ["stmt_hash"], df.limit(1).select("stmt_hash", "evidence_hash"))


def test_snapshot_clamp(spark):
    x = spark.createDataFrame([("2031-01-05 00:00:00",), ("2031-01-02 00:00:00",)], "t string").select(F.to_timestamp_ntz("t").alias("started_at"))
    at = lambda r: str(trace.clamped(x, r).first()["at"])
    assert at(None) == at("2035-01-01") == "2031-01-05 00:00:00" and at("2031-01-03 00:00:00") == "2031-01-03 00:00:00"
