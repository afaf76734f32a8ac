"""Look-alike spellings and copies hidden by formatting."""

import random
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from proofloom.llm import formatting, lookalike
from tests.conftest import rows

PAIRS = [
    ("ROZZ15 activates", "RОZZ15 activates"),  # Cyrillic O
    ("leaves at 18 °C", "leaves at 18 °C"),
    ("Ångvik mix", "Ångvik mix"),
    ("Ångvik mix", "Ångvik mix"),
    ("scaffold flat", "scaﬀold ﬂat"),
    ("Ser57 of", "Ｓｅｒ５７ of"),
    ("zero width", "ze​ro wid­th﻿"),
    ("KINASE", "KΙΝΑSΕ"),
    ("20 μM", "20 µM"),
    ("side mark", "si\u202ade\u202c m\ufe0fark\U000e0041"),
    ("filler", "fil\u3164ler\u061c"),
    ("what dull quill", "w\u04bbat \u0501u\u04cfl \u051buill"),
    ("cold", "\u03f2\u0585ld"),
    ("Å", "\u0410\u200b\u030a"),
]
DIFFERENT = [("naïve", "naive"), ("A B", "A  B"), ("A B", "A\tB"), ("a-b", "a–b"), ("Abc", "abc"), ("α-catex", "a-catex"), ("x1", "xl"), ('"q"', "“q”"), ("κ-light", "k-light"), ("x²", "x2")]


@pytest.mark.parametrize(("a", "b"), PAIRS)
def test_table_spelling_of_identical_looks(a, b):
    assert lookalike.table_spelling(a) == lookalike.table_spelling(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_table_spelling_keeps_visible_differences(a, b):
    assert lookalike.table_spelling(a) != lookalike.table_spelling(b)


def test_table_spelling_is_idempotent():
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(chr(rng.choice([rng.randrange(32, 0x600), rng.randrange(0x1E00, 0x2200), rng.randrange(0xFB00, 0xFFFD)])) for _ in range(6))
        s = s.encode("utf-8", "ignore").decode()
        once = lookalike.table_spelling(s)
        assert lookalike.table_spelling(once) == once, ascii(s)


def test_suspects_catch_all_that_the_table_changes(spark):
    chars = [chr(i) for i in [*range(32, 0x3100), *range(0xF900, 0x10000)] if unicodedata.category(chr(i)) not in ("Cs", "Cn")]
    got = dict(rows(spark.createDataFrame([(c,) for c in chars], "c string").select("c", lookalike.suspect("c"))))
    assert [ascii(c) for c in chars if lookalike.table_spelling(c) != c and not got[c]] == []
    assert not any(got[c] for c in "aZ 9éβ°ωЖ")


def test_trie_prefers_the_table_spelling_then_frequency():
    t = lookalike.Trie()
    for w, n in (("при", 5), ("OCA", 1), ("ОСА", 9)):
        t.add(w, n)
    assert lookalike.best("пpи", t.search("пpи")) == "при"
    assert lookalike.best("ОСA", t.search("ОСA")) == "OCA"
    assert lookalike.best("ﬁx", t.search("ﬁx")) == "fix"
    assert ("OCA", 1) in t.search("OCAT", 1) and not t.search("OCAT", 0)


def test_the_automaton_agrees_with_the_table_on_raw_tokens():
    rng = random.Random(8)
    pool = "aoceАВаеосﬁ" + "\u0301\u030a\u200b\u00ad\ufe0f" + "Ａｂ" + "éÅ" + "пи"
    words = ["".join(rng.choice("aocébipиABCfiÅ") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    t = lookalike.Trie()
    for w in set(filter(lookalike.well_formed, words)) | {"ao", "fi", "Åb", "é"}:
        t.add(w, 1)
    known = {w for w, _ in t.search("", 9)} | {"ao", "fi", "Åb", "é"}
    for _ in range(3000):
        token = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 5)))
        want = {w for w in known if lookalike.table_spelling(w) == lookalike.table_spelling(token)}
        if unicodedata.category(token[0])[0] != "M" and unicodedata.normalize("NFC", token[:1]) == token[:1]:
            assert {w for w, _ in t.search(token)} == want, ascii(token)


def test_tokens_with_a_common_beginning_part(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "BUCKET", 50)
    df = spark.createDataFrame([(f"https:\u200b//a.test/{i:04d}",) for i in range(2000)], "text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        x = lookalike.spellings(df)
        assert x.count() == 2000 and x.select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert x.filter("spelling like '%\u200b%'").count() == 0


def test_the_trie_decides_where_it_differs_from_the_table(spark):
    df = spark.createDataFrame([("пp\u200bи",), ("при",), ("при",)], "text string")
    assert {r["form"] for r in lookalike.consistent(df).collect()} == {"при"}
    assert lookalike.table_spelling("пp\u200bи") == lookalike.table_spelling("при") != "при"


def test_classes_count_their_links(spark):
    data = [("e", "a", "KINASE"), ("e", "b", "KΙΝΑSΕ"), ("e", "c", "KΙΝΑSΕ"), ("e", "c", "KINASE"), ("e", "d", "other"), ("f", "a", "KINASE")]
    df = spark.createDataFrame(data, "table_name string, key string, text string")
    assert rows(lookalike.lookalike_classes(df)) == [("e", "a", 3, 2, 3)]
    assert lookalike.lookalike_classes(df.limit(0)).count() == 0


def _pairs(data):
    out = set()
    for t, k, x in data:
        for u, m, y in data:
            if t == u and k and m and k < m and x and y and x != y and (s := lookalike.table_spelling(x)) and s == lookalike.table_spelling(y):
                out.add((t, k, m))
    return sorted(out)


def test_pairs_against_brute_force(spark):
    data = [("e", f"k{i:02d}{j}", x) for i, p in enumerate(PAIRS + DIFFERENT) for j, x in enumerate(p)]
    data += [("f", "k000", PAIRS[0][1]), ("e", "k000", PAIRS[0][0]), ("e", None, "x"), ("e", "n1", None), ("e", "n2", ""), ("e", "n3", "​"), ("e", "n4", "­"), ("e", "dup", "KΙΝΑSΕ"), ("e", "dup", "KΙΝΑSΕ"), ("e", "long", "a" * 100_000 + " "), ("e", "long2", "a" * 100_000 + " ")]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "table_name string, key string, text string, id int, token string")
    assert rows(lookalike.lookalike_pairs(df)) == _pairs(data)
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_forms_keep_rows_and_other_columns(spark):
    data = [("a", "KΙΝΑSΕ  x", 1), ("a", "KΙΝΑSΕ  x", 1), ("b", None, 2), ("c", "", 3), ("d", "plain\ttext", 4)]
    df = spark.createDataFrame(data, "id string, text string, form int")
    got = lookalike.consistent(df)
    assert got.columns == ["id", "text", "form"]
    assert rows(got.na.fill("-").select("id", "form")) == [("a", "KINASE  x"), ("a", "KINASE  x"), ("b", "-"), ("c", ""), ("d", "plain\ttext")]


def test_one_form_for_a_class_without_a_clean_member(spark):
    df = spark.createDataFrame([("пp­и",), ("при",), ("при​",)], "text string")
    assert {r["form"] for r in lookalike.consistent(df).collect()} == {"при"}


SAME = [
    ("reach", "Effect of A-1, in B (x < 2)."),
    ("Reach ", "  effect OF a–1 in\nB x < 2"),
    ("reach.", '"Effect of A1; in B x < 2!"'),
    ("signor", "NAME=a b; EFFECT=Up; X=1"),
    ("SIGNOR", "x=1;effect=up;name=A-B;"),
    ("signor", "NAME=ab; EFFECT=down; X=1"),
    ("reach", "Effect of A-1, in B (x > 2)."),
    ("trips", "Effect of A-1, in B (x < 2)."),
]


def test_copies(spark):
    data = [(f"k{i}", s, t) for i, (s, t) in enumerate(SAME)] + [("k0", *SAME[0]), ("n", "reach", None), ("e", "reach", ""), ("p", "reach", " .!"), ("q", None, "lone"), ("r", "", "lone"), (None, "reach", "x")]
    df = spark.createDataFrame([(*d, 0) for d in data], "key string, source string, text string, n int")
    want = [("k0", "k0", 3), ("k1", "k0", 3), ("k2", "k0", 3), ("k3", "k3", 2), ("k4", "k3", 2), ("k5", "k5", 1), ("k6", "k6", 1), ("k7", "k7", 1), ("q", "q", 2), ("r", "q", 2)]
    assert rows(formatting.formatting_copies(df)) == want
    assert formatting.formatting_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 3_000, 1 << 24])
def test_radix_counts_do_not_depend_on_the_buckets(spark, limit):
    rng = random.Random(limit)
    data = [(f"k{i:04d}", "prefix" * 3 + "".join(rng.choice("ab") for _ in range(rng.randrange(7)))) for i in range(1500)] + [(f"h{i}", "hot") for i in range(700)] + [("z", "x" * 50_000), ("y", "x" * 50_000), ("w", "")]
    want = defaultdict(list)
    for k, c in data:
        want[c].append(k)
    df = spark.createDataFrame(data, "key string, canon string").repartition(3)
    got = rows(formatting.count_copies(df, limit))
    assert got == sorted((bytearray(c.encode()), len(ks), min(ks)) for c, ks in want.items())


def test_count_trie():
    t = formatting.CountTrie()
    for w in (b"abc", b"ab", b"abd", b"", b"abc", b"x"):
        t.add(w, 1, w.decode() + "k")
    assert sorted(t) == [(b"", 1, "k"), (b"ab", 1, "abk"), (b"abc", 2, "abck"), (b"abd", 1, "abdk"), (b"x", 1, "xk")]
