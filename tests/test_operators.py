"""Skew-safe joins and ranks, components, references and nested documents."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from proofloom.lineage import cut, drop
from proofloom.operators import components, nested, references, skew
from tests.conftest import rows


def test_cut_and_drop(spark):
    t = cut(spark.range(10))
    assert t.count() == 10
    drop(t)
    drop(None)
    with pytest.raises(Exception):
        spark.read.parquet(t._proofloom_path).count()


@pytest.mark.parametrize("least", [1, 20_000])
def test_join_keyed_with_and_without_hot_keys(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "HOT_ROWS", least)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.2)
    big = cut(spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int"))
    keyed = cut(spark.createDataFrame([("a", 50, "x"), ("b", 1, "y"), ("d", 1, "z")], "k string, n long, w string"))
    assert rows(skew.join_keyed(big, keyed, "k", "n")) == sorted([("a", i, "x") for i in range(50)] + [("b", 1, "y")])
    assert skew.join_keyed(big.limit(0), cut(keyed.limit(0)), "k", "n").count() == 0


def test_bounded_broadcast_checks_the_size(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    small = spark.range(5)
    assert "broadcast" in plan(spark.range(9).join(skew.bounded_broadcast(small, 5), "id"))
    assert "broadcast" not in plan(spark.range(9).join(skew.bounded_broadcast(small, 4), "id"))


@pytest.mark.parametrize("block", [3, 4_000])
def test_product_join_gives_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(skew, "BLOCK", block)
    a = spark.createDataFrame([("h", i) for i in range(40)] + [("x", 1), (None, 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([("h", i) for i in range(5)] + [("x", 7), ("x", 7), (None, 2)], "k string, b int")
    assert rows(skew.product_join(a, b, ["k"])) == sorted([("h", i, j) for i in range(40) for j in range(5)] + [("x", 1, 7)] * 2)
    assert skew.product_join(a.limit(0), b, ["k"]).count() == 0


def test_ranked_numbers_every_group_without_gaps(spark):
    data = [("a", i) for i in range(500)] + [(None, i) for i in range(7)] + [("b", 1), ("b", 1)]
    df = spark.createDataFrame(data, "g string, v int")
    got = defaultdict(list)
    for r in skew.ranked(df, ["g"], F.xxhash64("v"), buckets=16).collect():
        got[r["g"]].append(r["rank"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(1, 501)), None: list(range(1, 8)), "b": [1, 2]}
    assert skew.ranked(df.limit(0), ["g"], F.xxhash64("v")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(45)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)] + [("x", None), (None, "y"), ("z", "z")]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = rows(components.connected(spark.createDataFrame(edges, "a string, b string")))
    assert got == sorted((n, find(n)) for n in up)
    assert components.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def _orphans(spark, match, refs, parents):
    r = spark.createDataFrame(refs, "a string, b string, other int")
    p = spark.createDataFrame(parents, "x string, y string, other string")
    return rows(references.orphans(r, ["a", "b"], p, ["x", "y"], match).select("a", "b", "cause").na.fill("-"))


def test_match_semantics_of_partly_null_keys(spark):
    refs = [("1", "2", 0), ("1", "9", 0), ("1", None, 0), ("7", None, 0), (None, "2", 0), (None, None, 0), ("1", "9", 5)]
    parents = [("1", "2", "u"), ("1", "3", "v")]
    assert _orphans(spark, "simple", refs, parents) == [("1", "9", "missing")]
    assert _orphans(spark, "partial", refs, parents) == [("1", "9", "missing"), ("7", "-", "missing")]
    assert _orphans(spark, "full", refs, parents) == [("-", "2", "partly_null"), ("1", "-", "partly_null"), ("1", "9", "missing"), ("7", "-", "partly_null")]
    assert _orphans(spark, "simple", [], parents) == []
    assert _orphans(spark, "simple", refs[:1], []) == [("1", "2", "missing")]
    with pytest.raises(ValueError):
        _orphans(spark, "other", refs, parents)


def test_early_and_deleted_references(spark):
    ts = lambda c: F.to_timestamp_ntz(F.col(c))
    r = spark.createDataFrame([("k", "2031-01-05"), ("k", "2031-02-09"), ("d", "2031-03-01"), ("l", "2031-03-01"), ("n", None)], "k string, t string").withColumn("t", ts("t"))
    p = spark.createDataFrame([("k", "2031-02-01"), ("d", "2031-01-01"), ("l", "2031-01-01"), ("l", "2031-05-01")], "k string, t string").withColumn("t", ts("t"))
    d = spark.createDataFrame([("d", "2031-01-01"), ("l", "2031-04-01"), ("k", "2030-01-01")], "k string, t string").withColumn("t", ts("t"))
    got = references.orphans(r, ["k"], p, ["k"], "simple", "t", "t", d, "t").select("k", "period", "cause").na.fill("-")
    assert rows(got) == [("d", "2031-03", "deleted"), ("k", "2031-01", "early"), ("n", "-", "missing")]


STATEMENT = {
    "type": "Complex",
    "matches_hash": "-5",
    "members": [None, {"name": "A", "bound_conditions": {"agent": {"name": "B", "bound_conditions": [{"agent": {"name": "C"}}]}}}, {"name": ""}],
    "subj": {"name": "S", "activity": {"activity_type": "kinase"}},
    "enz": None,
    "evidence": {"source_hash": -12, "text_refs": {"PMID": 7}},
    "supports": ["x"],
}


def _flat(spark, reader, docs):
    df = spark.createDataFrame([(f"k{i}", d, 1) for i, d in enumerate(docs)], "key string, j string, child_path int")
    return rows(nested.flatten(df, "t", "key", "j", reader).select("parent_key", "child_path", "child_value", "variant"))


def test_statement_documents(spark):
    doc = json.dumps(STATEMENT)
    want = [("evidence.0", "-12", "evidence"), ("members.1", "A", "agent"), ("members.1.bound_conditions.0.agent", "B", "agent"), ("members.1.bound_conditions.0.agent.bound_conditions.0.agent", "C", "agent"), ("subj", "S", "agent")]
    got = _flat(spark, "statement", [doc, json.dumps(doc), doc[:-5], "", None, "[]", "7", "null", '{"subj": {"name": "\\ud800x"}}'])
    assert got == sorted([(k, *w) for k in ("k0", "k1") for w in want] + [("k8", "subj", "?x", "agent")])
    assert _flat(spark, "statement", ['{"a":' * 100_000]) == []


def test_documents_of_any_depth_give_their_rows(spark):
    deep = '{"q":' * 50_000 + '{"name": "D"}' + "}" * 50_000
    doc = f'{{"type": "T", "subj": {{"name": "S", "x": {deep}}}, "obj": {{"name": "O"}}}}'
    bound = '{"agent": {"name": "B", "bound_conditions": ' * 400 + "null" + "}}" * 400
    got = _flat(spark, "statement", [doc, json.dumps(doc), f'{{"subj": {{"name": "S", "bound_conditions": {bound}}}}}', "[" * 50_000 + "]" * 50_000, doc[:-1]])
    assert [r[2] for r in got if r[0] == "k0"] == [r[2] for r in got if r[0] == "k1"] == ["O", "S", "D"]
    assert len([r for r in got if r[0] == "k2"]) == 401 and {r[0] for r in got} == {"k0", "k1", "k2"}


def test_deep_parser_agrees_with_the_library():
    rng = random.Random(3)
    base = json.dumps(STATEMENT)
    texts = [base, " [1, 2.5e3, -0, true, null, \"a\\u00e9\"] ", "{}", "[]", "1", '"x"', "01", "1.", "[1,]", "{,}", '{"a"}', "nul", "NaN", '{"a":1,"a":2}', "[1 2]", "", '"\x01"', "1e999", "-", "]"]
    for _ in range(400):
        i, j = rng.randrange(len(base)), rng.randrange(len(base))
        texts.append(base[:i] + rng.choice('{}[],:"0x ') + base[j:])
    for t in texts:
        try:
            want = json.loads(t, parse_constant=nested._no_constant, object_pairs_hook=dict)
        except ValueError:
            with pytest.raises(ValueError):
                nested.parse_deep(t, dict)
        else:
            assert nested.parse_deep(t, dict) == want


def test_evidence_and_reference_documents(spark):
    e = {"text_refs": {"PMID": 12, "DOI": None, "PMCID": ""}, "annotations": {"agents": {"raw_text": ["a", None, "b"]}}}
    assert _flat(spark, "evidence", [json.dumps(e), '{"annotations": {"agents": {"raw_text": "q"}}}', '{"text_refs": [], "annotations": null}']) == [
        ("k0", "annotations.agents.raw_text.0", "a", "raw_text"),
        ("k0", "annotations.agents.raw_text.2", "b", "raw_text"),
        ("k0", "text_refs.PMID", "12", "text_ref"),
        ("k1", "annotations.agents.raw_text.0", "q", "raw_text"),
    ]
    r = {"HGNC": 4, "UP": ["P1", None, "P2"], "LC": [["L1", 0.9], ["L2", 0.4]], "ONE": ["L3", 0.9], "TEXT": "", "NO": None}
    assert _flat(spark, "db_refs", [json.dumps(r), "{}", '{"A"']) == [("k0", "HGNC.0", "4", "db_id"), ("k0", "LC.0", "L1", "db_id"), ("k0", "LC.1", "L2", "db_id"), ("k0", "ONE.0", "L3", "db_id"), ("k0", "UP.0", "P1", "db_id"), ("k0", "UP.2", "P2", "db_id")]


def test_typed_tables_keep_parent_links(spark):
    df = spark.createDataFrame([("k", json.dumps(STATEMENT))], "key string, j string")
    nodes = nested.flatten(df, "t", "key", "j", "statement")
    t = nested.typed(nodes, "agent")
    assert t.columns == ["source_table", "parent_key", "child_path", "parent_path", "position", "role", "name"]
    assert {r["parent_path"] for r in t.collect()} == {"", "members.1", "members.1.bound_conditions.0.agent"}
    both = nested.common({v: nested.typed(nodes, v) for v in nested.TYPED})
    assert rows(both.select("child_path", "child_value", "variant")) == rows(nodes.select("child_path", "child_value", "variant"))
    assert nested.flatten(df.limit(0), "t", "key", "j", "statement").count() == 0
    ids = nested.typed(nested.flatten(spark.createDataFrame([("k", '{"LC": [["L1", 0.9], "L2"]}')], "key string, j string"), "t", "key", "j", "db_refs"), "db_id")
    assert rows(ids.select("namespace", "db_id", "score").na.fill(-1)) == [("LC", "L1", 0.9), ("LC", "L2", -1.0)]


def test_automaton_states():
    def state(x):
        return nested.Automaton().document(json.dumps(x)).state

    assert state(STATEMENT) == "statement"
    assert state({"agent": {"name": "x"}, "is_bound": True}) == "binding"
    assert state({"source_hash": 1}) == "evidence"
    assert state({"q": [[1], {"w": {"name": "x"}}]}) == "holder"
    assert state({"id": 3}) == "identified" and state({}) == "empty" and state({"z": []}) == "record"
    a = nested.Automaton()
    assert a.state(a.document('[null, {"name": "x"}, ["b", 0.5], []]')) == {"null", "agent", "scored", "list"}


@pytest.mark.parametrize(("name", "source", "doc", "kept"), [
    ("agent", "statement", STATEMENT, {"evidence"}),
    ("evidence", "statement", STATEMENT, {"agent"}),
    ("record", "evidence", {"text_refs": {"PMID": 1}, "annotations": {"agents": {"raw_text": ["a"]}}}, set()),
])
def test_the_states_decide_what_comes_out(monkeypatch, name, source, doc, kept):
    auto = nested.Automaton()
    before = {r[2] for r in nested.routed(auto.document(json.dumps(doc)), source, auto)}
    monkeypatch.setattr(nested, "RULES", [(n, (lambda s: False) if n == name else rule) for n, rule in nested.RULES[:-1]] + [("unknown", lambda s: True)])
    auto = nested.Automaton()
    after = {r[2] for r in nested.routed(auto.document(json.dumps(doc)), source, auto)}
    assert before > after and after == kept
