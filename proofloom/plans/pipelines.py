"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.lineage import scratch
from proofloom.plans import views as V
from proofloom.sources import documents, sinks
from proofloom.sources.tables import table
from proofloom.streaming import incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("SELECT event_id, user_id, value * 2 AS score FROM events WHERE event_type <> 'error'")
def r1_incremental_scoring(s, d):
    """The events scored as a stream and read back from the log."""
    base = scratch(s, "stream")
    schema = table(s, d, "events").schema.simpleString()[7:-1].replace(":", " ")
    q = incremental.scored_stream(s, f"{d}/events.parquet*", schema, f"{base}/log", f"{base}/state", lambda b: b.filter("event_type <> 'error'").select("event_id", "user_id", (F.col("value") * 2).alias("score")), "event_id")
    q.awaitTermination()
    return s.read.parquet(f"{base}/log").select("event_id", "user_id", "score")


@query("WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 2 = 0) SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)")
def k1_upsert(s, d):
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return sinks.upserted(x.filter("k % 3 <> 0"), x.filter("k % 2 = 0").withColumn("v", F.col("v") + 1), ["k"])


@query("SELECT count(DISTINCT source_hash) AS keys, count(DISTINCT source_hash) FILTER (source_hash IN (SELECT source_hash FROM fewshot_pool WHERE split = 'train')) AS present FROM fewshot_pool WHERE split <> 'train'")
def s9_already_present(s, d):
    p = table(s, d, "fewshot_pool")
    return documents.already_present(p.filter("split <> 'train'"), p.filter("split = 'train'"), "source_hash")


@query("SELECT a.record_id AS claim_id, b.record_id AS entry FROM fewshot_pool a LEFT JOIN fewshot_pool b ON a.source_hash = b.source_hash AND b.split = 'train' WHERE a.split = 'test' QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY coalesce((len(list_filter([lower(a.subject)], lambda x: x is null or x NOT IN (lower(b.subject), lower(b.object)))) > 0)::INT, 1), b.record_id) = 1")
def s5_index_lookup(s, d):
    p = table(s, d, "fewshot_pool")
    index = p.filter("split = 'train'").select("source_hash", F.col("record_id").alias("position"), F.array(F.lower("subject"), F.lower("object")).alias("agents"), F.col("record_id").alias("entry"))
    claims = p.filter("split = 'test'").select(F.col("record_id").alias("claim_id"), "source_hash", F.array(F.lower("subject")).alias("names"))
    return documents.lookup(index, claims).select("claim_id", "entry")


@query("WITH c AS (SELECT event_id, ts, sum(value) OVER (ORDER BY date_trunc('day', ts), ts, event_id) - value AS before FROM events) SELECT event_id FROM c WHERE round(before, 6) <= 20000")
def r6_cost_brake(s, d):
    x = table(s, d, "events").withColumn("day", F.to_date("ts")).withColumn("value", F.col("value").cast("decimal(20,6)"))
    return incremental.within_budget(x, "value", 20000, ["day", "ts", "event_id"]).select("event_id")


@query("SELECT run_id, CASE WHEN status = 'running' AND ((s_suppkey % 3 > 0 AND started_at + INTERVAL 1 HOUR < TIMESTAMP '2024-01-03' - INTERVAL 10 MINUTE) OR (s_suppkey % 3 = 0 AND started_at < TIMESTAMP '2024-01-03' - INTERVAL 6 HOUR)) THEN 'crashed' ELSE status END AS state FROM (SELECT *, 'r' || s_suppkey AS run_id, CASE s_nationkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'succeeded' END AS status, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(s_suppkey AS INT)) AS started_at FROM supplier)")
def i20_stale_runs(s, d):
    runs = V.run(s, d).withColumn("heartbeat_at", F.when(F.substring("run_id", 2, 20).cast("bigint") % 3 > 0, F.col("started_at") + F.make_dt_interval(hours=F.lit(1))))
    return incremental.stale(runs, "2024-01-03 00:00:00").select("run_id", "state")
