"""Grouped splits, proportional samples and overlaps across splits."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import overlap, sampling, splits
from tests.conftest import rows


def _pool(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        keys = [f"p{rng.randrange(200)}" if rng.random() < 0.7 else None, f"m{rng.randrange(260)}" if rng.random() < 0.7 else None]
        out.append((f"r{i:04d}", keys, rng.choice(["a", "b", None])))
    return out


def _find(data):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for r, keys, _ in data:
        top(r)
        for k in keys:
            if k is not None:
                by[k].append(r)
    for rs in by.values():
        for r in rs[1:]:
            a, b = top(rs[0]), top(r)
            up[max(a, b)] = min(a, b)
    return {r: top(r) for r in list(up)}


SCHEMA = "id string, keys array<string>, label string"


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_keep_groups_and_come_close_to_quotas(spark, seed):
    data = _pool(seed)
    t = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split string, target_share double")
    got = splits.grouped_splits(spark.createDataFrame(data + data[:5], SCHEMA), t).collect()
    assert {r["id"]: r["first"] for r in got} == _find(data) and len(got) == len(data)
    by = defaultdict(set)
    for r in got:
        by[r["first"]].add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    sizes, most = Counter(r["split"] for r in got), max(Counter(r["first"] for r in got).values())
    for s, share in (("train", 0.8), ("valid", 0.1), ("test", 0.1)):
        assert abs(sizes[s] - share * len(data)) <= max(most, 5)


def test_splits_of_odd_pools(spark):
    t = spark.createDataFrame([("train", 1.0), ("test", 1.0)], "split string, target_share double")
    one = spark.createDataFrame([("a", ["k"], "x"), ("b", ["k"], None), ("c", [None], "x"), ("d", [], "x"), (None, ["k"], "x")], SCHEMA)
    assert {r["id"] for r in splits.grouped_splits(one, t).collect()} == {"a", "b", "c", "d"}
    assert splits.grouped_splits(one.limit(0), t).count() == 0
    with pytest.raises(ValueError):
        splits.grouped_splits(one, t.limit(0))


def test_keys_of_the_pool(spark):
    x = spark.createDataFrame([("PMID: 20", " -7 "), ("20 ", "-07"), ("n/a", "None"), ("", ""), (None, None)], "p string, m string")
    assert [tuple(r) for r in x.select(splits.digits("p"), splits.number("m")).collect()] == [("20", "-7"), ("20", "-7"), (None, None), (None, None), (None, None)]


def test_allocation_is_whole_and_meets_quotas():
    plan = splits.allocate([(10, "a", 3), (3, "a", 7), (1, "b", 49)], {"train": 0.8, "valid": 0.1, "test": 0.1})
    for (size, label, n) in [(10, "a", 3), (3, "a", 7), (1, "b", 49)]:
        assert sum(plan[size, label].values()) == n
    got = {s: sum(size * c[s] for (size, _), c in plan.items()) for s in ("train", "valid", "test")}
    assert got == {"train": 80, "valid": 10, "test": 10}


def test_many_labels_and_bundles_are_no_burden():
    began = time.time()
    totals = {f"l{i}": 1 + i * 7919 % 997 for i in range(20_000)}
    shares = {"train": 0.8, "valid": 0.1, "test": 0.1}
    q = splits.quotas(totals, shares)
    assert all(sum(q[k].values()) == n for k, n in totals.items())
    total = sum(totals.values())
    assert all(abs(sum(v[x] for v in q.values()) - shares[x] * total) <= 1 for x in shares)
    assert all(abs(q[k][x] - n * shares[x]) < 2 for k, n in totals.items() for x in shares)
    assert time.time() - began < 10


def test_dealing_is_even_and_exact(spark):
    df = spark.range(1, 101).select("id", F.array(*[F.struct(F.lit(x).alias("split"), F.lit(k).cast("bigint").alias("k")) for x, k in (("a", 80), ("b", 13), ("c", 7), ("d", 0))]).alias("p"))
    got = [r[0] for r in df.select(splits.dealt(F.col("id"), F.col("p"))).collect()]
    assert Counter(got) == {"a": 80, "b": 13, "c": 7}
    assert all(abs(Counter(got[i : i + 20])["a"] - 16) <= 1 for i in range(80))


def test_profiles_keep_their_proportions(spark):
    rng = random.Random(4)
    data = []
    for g in range(900):
        for j in range(rng.choice([1, 1, 2, 3])):
            data.append((f"r{g:04d}{j}", [f"k{g}"], rng.choice(["x", "x", "y", "z"])))
    t = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, target_share double")
    got = splits.grouped_splits(spark.createDataFrame(data, SCHEMA), t)
    label = {r: x for r, _, x in data}
    n = Counter((label[r["id"]], r["split"]) for r in got.collect())
    for x in "xyz":
        assert abs(n[x, "train"] - n[x, "test"]) <= 0.06 * (n[x, "train"] + n[x, "test"]) + 4


def _targets(spark, data, size):
    return spark.createDataFrame([(f, c, s, m, size) for f, c, s, m in data], "category_field string, category string, target_share double, min_rows int, sample_size int")


def test_sample_against_brute_force(spark):
    pool = [(i, "Big " if i % 2 else "BIG", None) for i in range(300)] + [(1000 + i, "mid-dle", None) for i in range(40)] + [(2000 + i, "Small", None) for i in range(4)] + [(5, "big", None), (None, "big", None), (3000, None, None), (3001, "other", None)]
    df = spark.createDataFrame(pool, "source_hash long, tag string, rank int")
    t = _targets(spark, [("tag", "big", 0.5, 2), ("tag", "Mid dle", 0.3, 2), ("tag", "small", 0.2, 6), ("tag", "none", 0.0, 1)], 60)
    got = Counter(r["category"] for r in sampling.proportional_sample(df, "source_hash", ["tag"], t).collect())
    seats = sorted([(r >= 2, (r + 0.5) / 0.5, "big") for r in range(300)] + [(r >= 2, (r + 0.5) / 0.3, "Mid dle") for r in range(40)] + [(r >= 6, (r + 0.5) / 0.2, "small") for r in range(4)])[:60]
    assert got == Counter(c for _, _, c in seats)
    rep = {r["category"]: (r["required"], r["available"], r["drawn"], r["short"]) for r in sampling.sample_report(df, "source_hash", ["tag"], t).collect()}
    assert rep == {"big": (30, 300, got["big"], False), "Mid dle": (18, 40, got["Mid dle"], False), "small": (12, 4, 4, True), "none": (1, 0, 0, True)}
    assert sampling.proportional_sample(df.limit(0), "source_hash", ["tag"], t).count() == 0
    assert {r["available"] for r in sampling.sample_report(df.limit(0), "source_hash", ["tag"], t).collect()} == {0}


def test_sample_is_random_but_repeatable(spark):
    df = spark.createDataFrame([(i, "a") for i in range(200)], "source_hash long, tag string")
    t = _targets(spark, [("tag", "a", 1.0, 1)], 50)
    draw = lambda seed: {r["unit"] for r in sampling.proportional_sample(df, "source_hash", ["tag"], t, seed).collect()}
    assert draw(1) == draw(1) and draw(1) != draw(2) and len(draw(1)) == 50 and max(draw(1)) > 60


def test_joint_sample_meets_both_margins(spark):
    rng = random.Random(1)
    pool = [(i, f"r{i}", rng.choice("aaaab"), rng.choice("xxyyz")) for i in range(2000)]
    df = spark.createDataFrame(pool, "source_hash long, record_id string, tag string, kind string")
    t = _targets(spark, [("tag", "a", 0.5, 1), ("tag", "b", 0.5, 1), ("kind", "x", 0.2, 1), ("kind", "y", 0.2, 1), ("kind", "z", 0.6, 1)], 300)
    got = sampling.joint_sample(df, "source_hash", "record_id", ["tag", "kind"], t).collect()
    assert len(got) == 300 and len({r["unit"] for r in got}) == 300
    for f, want in (("tag", {"a": 150, "b": 150}), ("kind", {"x": 60, "y": 60, "z": 180})):
        n = Counter(r[f] for r in got)
        assert all(abs(n[c] - k) <= 4 for c, k in want.items())


def test_fitted_margins_respect_what_is_available():
    x = sampling.fitted(np.array([[5.0, 0.0], [50.0, 50.0]]), [np.array([10.0, 30.0]), np.array([25.0, 15.0])])
    assert (x <= np.array([[5.0, 0.0], [50.0, 50.0]]) + 1e-9).all()


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_against_the_full_table():
    rng = random.Random(5)
    for _ in range(4000):
        a = [rng.choice("abcd") for _ in range(rng.randrange(14))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(14))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.85]
        k = rng.randrange(6)
        assert overlap.distance_within(a, b, k) == (_distance(a, b) <= k), (a, b, k)


def _edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w) + 1)
        how = rng.randrange(3)
        if how == 0:
            w.insert(i, rng.choice(VOCABULARY))
        elif w and how == 1:
            w.pop(min(i, len(w) - 1))
        elif w:
            w[min(i, len(w) - 1)] = rng.choice(VOCABULARY)
    return w


VOCABULARY = [f"w{i}" for i in range(12)] + [f"rare{i}" for i in range(400)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice(VOCABULARY[:12] if rng.random() < 0.6 else VOCABULARY) for _ in range(rng.choice([1, 3, 6, 7, 8, 14, 25, 50, 58, 61, 64, 72, 90]))] for _ in range(40)]
    data = []
    for i in range(260):
        b = rng.choice(base)
        w = _edited(rng, b, rng.choice([0, 0, 1, 2, len(b) * 15 // 100, len(b) * 18 // 100]))
        text = rng.choice([" ", ", "]).join(w)
        data.append((f"r{i:03d}", rng.choice([text, text.upper(), f"{text}."]), rng.choice([None, *range(150)]), rng.random() < 0.6))
    data += [("e1", "", 7, True), ("e2", None, 7, False), ("e3", "...", None, True), ("e4", "...", None, False), ("e5", "x", 1, None), (None, "w1", 1, True), data[0]]
    from proofloom.functions.text import words_of

    want = set()
    for a, t, s, tr in data:
        for b, u, r, tr2 in data:
            if tr and tr2 is False and a and b:
                x, y = words_of(t), words_of(u)
                k = max(len(x), len(y)) * 15 // 100
                if (s is not None and s == r) or (x and y and _distance(x, y) <= k):
                    want.add((a, b))
    df = spark.createDataFrame([(*d, "q") for d in data], "id string, text string, source long, train boolean, f string")
    got = overlap.split_overlaps(df)
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    assert overlap.split_overlaps(df.limit(0)).count() == 0


def test_every_near_pair_shares_a_signature(spark):
    rng = random.Random(9)
    base = [[rng.choice(VOCABULARY) for _ in range(n)] for n in (6, 7, 13, 27, 40, 51, 55, 60, 66, 70)]
    texts = [(bytes([i]), b, True, True) for i, b in enumerate(base)] + [(bytes([100 + i]), _edited(rng, b, len(b) * 15 // 100), True, True) for i, b in enumerate(base)]
    df = spark.createDataFrame([(bytearray(f), w, left, right) for f, w, left, right in texts], "f binary, words array<string>, left boolean, right boolean")
    pairs = {(bytes(r["a"])[0], bytes(r["b"])[0]) for r in overlap.near_texts(df).filter(F.col("cosine") > 0).collect()}
    for i, b in enumerate(base):
        other = texts[len(base) + i][1]
        if other != b and _distance(b, other) <= max(len(b), len(other)) * 15 // 100:
            assert (i, 100 + i) in pairs and (100 + i, i) in pairs


@pytest.mark.parametrize("block", [4_000, 3])
def test_short_texts_of_one_pattern_lose_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr("proofloom.operators.skew.BLOCK", block)
    six, seven = VOCABULARY[:6], VOCABULARY[6:13]
    left = [" ".join([*six, f"x{i}"]) for i in range(9)] + [" ".join([f"v{i}", *seven]) for i in range(9)] + [" ".join(six)]
    right = [" ".join([f"y{i}", *six]) for i in range(9)] + [" ".join([*six[:3], f"z{i}", *six[3:]]) for i in range(9)] + [" ".join([*seven, f"u{i}"]) for i in range(3)] + [" ".join([f"w{i}", *seven]) for i in range(9)]
    df = spark.createDataFrame([(f"a{i}", t, None, True) for i, t in enumerate(left)] + [(f"b{i}", t, None, False) for i, t in enumerate(right)], "id string, text string, source long, train boolean")
    near = lambda x, y: _distance(x, y) <= max(len(x), len(y)) * 15 // 100
    want = {(f"a{i}", f"b{j}") for i, x in enumerate(left) for j, y in enumerate(right) if near(x.split(), y.split())}
    got = {(r["a"], r["b"]) for r in overlap.split_overlaps(df).collect()}
    assert got == want and len(want) > 81
