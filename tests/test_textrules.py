"""Text rules."""

from pyspark.sql import functions as F

from proofloom.functions import text, textrules
from tests.conftest import rows


def test_words_agree_in_both_engines(spark):
    samples = ["A-b_c 12x", "", None, "Größe ÄÖ é中文 x²", "a\nb\tc", "…", "x" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", text.words("t")).collect()}
    assert got == {i: text.words_of(t) for i, t in enumerate(samples)}


def test_keys(spark):
    df = spark.createDataFrame([(" Ab\t",), ("",), (" \n",), (None,)], "k string")
    assert [r[0] for r in df.select(text.key("k")).collect()] == ["ab", None, None, None]


def test_sites_hedges_and_mediators(spark):
    df = spark.createDataFrame([("It may act at Ser57 and Ser-57 or Thr12 via exon 9 of AB12",), (None,), ("",)], "t string")
    r = df.select(textrules.sites(F.col("t")), textrules.hedged(F.col("t")), textrules.mediators(F.col("t"))).collect()
    assert (r[0][0], r[0][1], r[0][2]) == (["Ser57", "Thr12"], True, ["AB12"])
    assert r[1][1] is None and r[2][0] == [] and r[2][1] is False
    s = spark.createDataFrame([("s", "5"), ("Thr", "7"), (None, "9"), ("S", None)], "r string, p string")
    assert [x[0] for x in s.select(textrules.site_of(F.col("r"), F.col("p"))).collect()] == ["Ser5", "Thr7", "9", None]


def test_relations_and_binding(spark):
    df = spark.createDataFrame([(1, "AB1 activates CD2 and EF3 is blocked by AB1."), (2, "AB1 activates AB1"), (3, None), (4, "")], "k int, t string")
    r = textrules.relations(df, "k", "t")
    assert rows(r) == [(1, "activates", 1, "AB1", "CD2"), (1, "blocked_by", -1, "AB1", "EF3")]
    a = spark.createDataFrame([("AB1", "x", 1), ("AB1", "w", 0), ("CD2", "w", 0), ("EF3", "z", 0)], "alias string, canonical string, position int")
    assert rows(textrules.bound(r, a).select("agent_id", "target_id")) == [("w", "z")]


def test_local_hedges(spark):
    data = [
        ("ABC1 may bind XYZ2.", ["ABC1", "XYZ2"], ["may"]),
        ("ABC1 binds XYZ2; it may matter.", ["ABC1"], []),
        ("We propose that " + "x" * 70 + " then ABC1 binds.", ["ABC1"], []),
        ("It is thought to be so. ABC1 binds.", ["ABC1"], []),
        ("ABC1 is thought to act, possibly on X.", ["abc1", "X"], ["is thought to", "possibly"]),
        (None, ["ABC1"], []),
        ("may be", None, []),
    ]
    df = spark.createDataFrame([(t, n) for t, n, _ in data], "t string, n array<string>")
    assert [r[0] for r in df.select(textrules.local_hedges(F.col("t"), F.col("n"))).collect()] == [w for _, _, w in data]


def test_alias_positions(spark):
    data = [("RSK2 binds rsk2 and RPS6KA3.", ["RSK2", "RPS6KA3", "R"], [0, 11, 20]), ("RSK21", ["RSK2"], []), ("a+b.c", ["b.c", "+b"], [1, 2]), (None, ["ab"], []), ("ab", None, []), ("", ["ab"], [])]
    df = spark.createDataFrame([(t, a) for t, a, _ in data], "t string, a array<string>")
    assert [r[0] for r in df.select(textrules.alias_positions(F.col("t"), F.col("a"))).collect()] == [w for _, _, w in data]
