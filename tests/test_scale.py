"""The scale corpus: 8,724 generated statements through ingest, mock scoring, validity and export."""

import time

from pyspark.sql import functions as F

from proofloom.operators import ingest, validity
from proofloom.sources import sinks

N = 8_724
SOURCES = ["reach", "biopax", "biogrid", "signor", "trips"]


def corpus(spark):
    """Statements with 1 + i % 4 evidences over 50 names, three types and five sources."""
    agent = lambda k: F.struct(F.concat(F.lit("PROT"), (F.col("id") + k) % 50).alias("name"))
    api = F.array(*map(F.lit, SOURCES))
    one = lambda j: F.struct(
        F.element_at(api, (j % 5 + 1).cast("int")).alias("source_api"),
        (100_000 + 4 * F.col("id") + j).cast("string").alias("pmid"),
        F.concat(F.lit("text "), F.col("id"), F.lit(" "), j).alias("text"),
        (F.col("id") * 4 + j).alias("source_hash"),
        F.struct(((F.col("id") + j) % 3 != 0).alias("direct"), ((F.col("id") + j) % 5 == 0).alias("curated")).alias("epistemics"),
    )
    kind = F.element_at(F.array(*map(F.lit, ("Phosphorylation", "Activation", "Inhibition"))), (F.col("id") % 3 + 1).cast("int"))
    doc = F.struct(kind.alias("type"), F.concat(F.lit("u"), "id").alias("id"), F.col("id").cast("string").alias("matches_hash"), (F.col("id") % 100 / 100).alias("belief"), agent(0).alias("subj"), agent(1).alias("obj"), F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), one).alias("evidence"))
    return spark.range(N).select(F.to_json(doc).alias("raw_json"))


def test_scale_corpus(spark, tmp_path):
    began = time.time()
    raw = str(tmp_path / "raw")
    corpus(spark).write.parquet(raw)
    docs = ingest.parsed(spark.read.parquet(raw))
    for name, df in (("statement", ingest.statements(docs)), ("evidence", ingest.evidences(docs)), ("member", ingest.memberships(docs).drop("e")), ("agent", ingest.agents(docs))):
        df.write.parquet(str(tmp_path / name))
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    assert (read("statement").count(), read("evidence").count(), read("member").count(), read("agent").count()) == (N, 21_810, 21_810, 2 * N)
    assert time.time() - began < 60

    began = time.time()
    e = read("evidence")
    score = F.when(F.col("curated"), 0.92).when(F.col("direct"), 0.75).otherwise(0.50)
    verdict = F.when(F.col("curated") | F.col("direct"), "correct").otherwise("abstain")
    steps = read("member").join(e.select("evidence_hash", score.alias("score"), verdict.alias("verdict")), "evidence_hash").withColumn("run_id", F.lit("r"))
    steps.write.parquet(str(tmp_path / "step"))
    scores = validity.statement_scores(read("step"))
    cal = validity.calibration(validity.residuals(scores, read("statement")), ["run_id"]).first()
    assert cal["n_stmts"] == N and 0 < cal["mae"] < 1
    assert {r["verdict"] for r in validity.shares(read("step")).collect()} == {"correct", "abstain"}
    assert time.time() - began < 120

    began = time.time()
    keyed = spark.read.parquet(raw).select(ingest.hex16(F.get_json_object("raw_json", "$.matches_hash")).alias("stmt_hash"), "raw_json")
    sinks.export_statements(keyed, scores.select("stmt_hash", F.col("our_score").alias("belief")), str(tmp_path / "export"))
    assert spark.read.text(str(tmp_path / "export")).count() == N
    assert time.time() - began < 30
