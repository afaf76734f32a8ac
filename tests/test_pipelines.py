"""Sources, sinks and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from proofloom.sources import documents, sinks
from proofloom.streaming import incremental
from tests.conftest import rows


def test_json_array_and_lines(spark, tmp_path):
    data = [{"id": "a", "n": 12345678901234567}, {"id": "b"}]
    (tmp_path / "x.json").write_text(json.dumps(data))
    with gzip.open(tmp_path / "y.json.gz", "wt") as f:
        json.dump(data[:1], f)
    got = sorted(r[0] for r in documents.statement_array(spark, str(tmp_path / "*.json*")).collect())
    assert [json.loads(g)["id"] for g in got] == ["a", "a", "b"] and json.loads(got[0])["n"] == 12345678901234567
    (tmp_path / "l.jsonl").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    ok, bad = documents.json_lines(spark, str(tmp_path / "l.jsonl"), "k int")
    assert rows(ok) == [(1,), (2,)] and rows(bad) == [("broken",)]
    assert {r["kind"] for r in documents.discover(spark, str(tmp_path)).collect()} == {"json", "jsonl"}


def test_upsert_is_null_safe_and_keeps_the_last(spark):
    old = spark.createDataFrame([(1, "a", 0), (None, "b", 0), (2, "c", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(None, "n", 1), (2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, t int")
    got = sinks.upserted(old, new, ["k"], "t").select("k", "v").na.fill(-1)
    assert rows(got) == [(-1, "n"), (1, "a"), (2, "y"), (3, "z")]
    assert sinks.upserted(old, new.limit(0), ["k"]).count() == 3


def test_append_log_and_replace_runs(spark, tmp_path):
    log = str(tmp_path / "log")
    a = spark.createDataFrame([("h1", "r1", 1), ("h1", "r1", 1), ("h2", "r1", 2)], "step_hash string, run_id string, started_at int")
    assert sinks.append_log(a, log) == 2
    assert sinks.append_log(a, log) == 0
    assert sinks.read_log(spark, log).count() == 2
    m = str(tmp_path / "metric")
    sinks.replace_runs(spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "run_id string, value double"), m)
    sinks.replace_runs(spark.createDataFrame([("r2", 3.0)], "run_id string, value double"), m)
    assert rows(spark.read.parquet(m).select("run_id", "value")) == [("r1", 1.0), ("r2", 3.0)]


def test_export_replaces_belief(spark, tmp_path):
    st = spark.createDataFrame([("a", '{"id": "a", "belief": 0.1}'), ("b", '{"id": "b", "belief": 0.2}')], "stmt_hash string, raw_json string")
    b = spark.createDataFrame([("a", 0.75)], "stmt_hash string, belief double")
    out = str(tmp_path / "out")
    sinks.export_statements(st, b, out)
    assert [json.loads(r[0])["belief"] for r in spark.read.text(out).collect()] == [0.75, 0.2]
    sinks.export_statements(st, b, out, only_scored=True)
    assert spark.read.text(out).count() == 1
    sinks.export_statements(st, b.limit(0), out, only_scored=True)
    assert spark.read.text(out).count() == 2


def test_model_card(spark):
    m = spark.createDataFrame([("r", "mae", "{}", 0.1), ("r", "bad", "{}", float("nan")), ("q", "mae", "{}", 9.0)], "run_id string, metric_name string, slice_json string, value double")
    led = spark.createDataFrame([(None, "corpus", "statements", 3), ("q", "run", "steps", 4)], "run_id string, family string, kind string, value int")
    assert sinks.model_card("r", m, led) == {"run_id": "r", "metrics": {"mae": 0.1, "bad": None}, "denominators": {"corpus.statements": 3}}


def test_stream_resumes_and_repeats_nothing(spark, tmp_path):
    src, log, state = (str(tmp_path / x) for x in ("src", "log", "state"))

    def run():
        incremental.scored_stream(spark, src, "id int, v int", log, state, lambda b: b.select(F.col("id").alias("step_hash"), (F.col("v") + 1).alias("s"))).awaitTermination()
        return rows(spark.read.parquet(log).select("step_hash", "s"))

    spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "id int, v int").write.parquet(src)
    assert run() == [(1, 2), (2, 3)]
    spark.createDataFrame([(2, 2), (3, 3)], "id int, v int").write.mode("append").parquet(src)
    assert run() == [(1, 2), (2, 3), (3, 4)]
    assert run() == [(1, 2), (2, 3), (3, 4)]


def test_watermarked_windows(spark, tmp_path):
    src = str(tmp_path / "w")
    spark.createDataFrame([("2031-01-01 00:00:10", "a", 1.0), ("2031-01-01 00:04:00", "a", 2.0), ("2031-01-01 00:06:00", "a", 5.0)], "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    s = spark.readStream.schema("ts timestamp, k string, value double").parquet(src)
    q = incremental.windowed_counts(s, "ts", "k", "5 minutes", "1 minute").writeStream.format("memory").queryName("wc").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("wc").select("n", "total")) == [(1, 5.0), (2, 3.0)]


def test_budget(spark):
    x = spark.createDataFrame([(1, 1, 4.0), (1, 2, None), (2, 1, 7.0), (2, 2, 1.0), (3, 1, 1.0)], "d int, i int, c double")
    assert rows(incremental.within_budget(x, "c", 10, ["d", "i"]).select("d", "i")) == [(1, 1), (1, 2), (2, 1)]


def test_a_log_that_cannot_be_read_is_no_empty_log(spark, tmp_path):
    log = str(tmp_path / "log")
    a = spark.createDataFrame([("a", "r", 1)], "step_hash string, run_id string, v int")
    assert not sinks.has_rows(spark, log) and sinks.append_log(a, log) == 1 and sinks.has_rows(spark, log)
    for p in (tmp_path / "log").rglob("*.parquet"):
        p.write_bytes(b"broken")
    for p in (tmp_path / "log").rglob("*.crc"):
        p.unlink()
    with pytest.raises(Exception):
        sinks.append_log(a, log)
