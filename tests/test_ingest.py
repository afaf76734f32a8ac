"""Documents of other shapes: wrapped in JSON strings, single objects where others have arrays."""

import json

from pyspark.sql import functions as F

from proofloom.operators import ingest
from tests.conftest import rows
from tests.test_model import DOCS

ONE = {"type": "Complex", "id": "u4", "matches_hash": "14", "members": {"name": "D"}, "supported_by": ["u2"], "evidence": {"source_hash": 7, "epistemics": {"curated": True}}}


def wrapped(x, times):
    for _ in range(times):
        x = json.dumps(x)
    return x


def test_wrapped_documents_count_as_the_document_inside(spark):
    plain, odd = ([(wrapped(d, 1),) for d in DOCS], [(wrapped(d, 2 + 2 * i),) for i, d in enumerate(DOCS)])
    broken = [('"{broken"',), ('"',), (wrapped("[1]", 3),), (wrapped("text", 2),), (None,), ("",)]
    a, b = (ingest.parsed(spark.createDataFrame(x, "raw_json string")) for x in (plain, odd + broken))
    for f in (ingest.statements, ingest.agents, ingest.edges):
        assert rows(f(a)) == rows(f(b)) != []
    assert rows(ingest.memberships(a).drop("e")) == rows(ingest.memberships(b).drop("e")) != []


def test_single_objects_are_arrays_of_one(spark):
    docs = ingest.parsed(spark.createDataFrame([(json.dumps(ONE),), (wrapped(ONE, 2),)], "raw_json string"))
    assert rows(ingest.memberships(docs).drop("e").distinct()) == [("000000000000000e", "0000000000000007", 0)]
    assert rows(ingest.agents(docs).distinct()) == [("000000000000000e", "member", 0, "D")]
    assert rows(ingest.evidences(docs).select("evidence_hash", "curated")) == [("0000000000000007", True)]
    assert rows(ingest.edges(docs).select("to_hash")) == [("u2",)]
    keyed = docs.select(F.lit("k").alias("stmt_hash"), "raw_json")
    stored = spark.createDataFrame([("k", "0000000000000007")], "stmt_hash string, evidence_hash string")
    assert rows(ingest.denominators(keyed, stored)) == []
    assert rows(ingest.denominators(keyed, stored.limit(0))) == [("k", 1, 0)]
