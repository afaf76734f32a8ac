"""The stratified sample with a type cap and tag minimums."""

from collections import Counter

from proofloom.operators import evaluation
from tests.conftest import rows

POOL = [(f"r{i:04}", ("A", "A", "A", "B", "C", None)[i % 6], ("rare" if i % 50 == 0 else "common") if i % 7 else None) for i in range(1200)]
LEAST = {"rare": 10, "common": 0.2, "absent": 3}


def drawn(spark, target, pool=POOL, least=LEAST, **more):
    df = spark.createDataFrame(pool, "id string, cls string, tag string")
    return rows(evaluation.stratified_sample(df, target, least=least, **more).na.fill("?"))


def test_size_cap_and_minimums(spark):
    got = drawn(spark, 100)
    types, tags = Counter(r[1] for r in got), Counter(r[2] for r in got)
    assert len(got) == len({r[0] for r in got}) == 100 and set(got) <= {(a, b or "?", c or "?") for a, b, c in POOL}
    assert max(types.values()) <= 35 and tags["rare"] >= 10 and tags["common"] >= 20
    assert got == drawn(spark, 100) != drawn(spark, 100, seed=7)
    assert max(Counter(r[1] for r in drawn(spark, 200)).values()) <= 70


def test_pools_that_run_out(spark):
    one_type = [(f"r{i}", "A", "common") for i in range(50)]
    assert len(drawn(spark, 20, one_type)) == 7
    assert len(drawn(spark, 20, one_type, {"common": 15})) == 7
    assert len(drawn(spark, 20, one_type, {"common": 30}, cap_share=1.0)) == 20
    assert drawn(spark, 20, []) == []
    assert len(drawn(spark, 10_000, cap_share=1.0)) == len(POOL)
