"""Modification sites in all written forms."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from proofloom.functions import siterules

CASES = [
    ("phosphorylated at S473 and T-308", ["Ser473", "Thr308"]),
    ("serine 102 and Tyr 732, Lys-48", ["Ser102", "Tyr732", "Lys48"]),
    ("S473 was elevated", []),
    ("phosphorylation (Fig. S4), S100 protein, Y99 receptor", []),
    ("phosphorylation of S0 and serine 0", []),
    ("phosphorylation of A" + "x " * 30 + "S473", []),
    (None, []),
    ("", []),
]


@pytest.mark.parametrize(("text", "found"), CASES)
def test_forms(text, found):
    assert siterules.spaced_and_letter_sites(text) == found


def test_all_forms_in_a_column(spark):
    df = spark.createDataFrame([("Ser57 and Ser 57, phosphorylation at S58",), (None,)], "t string")
    assert [sorted(r[0]) for r in df.select(siterules.sites(F.col("t"))).collect()] == [["Ser57", "Ser58"], []]


def test_query_takes_letter_and_spaced_forms(spark, tmp_path):
    spark.createDataFrame([("a", "phosphorylated on S473"), ("b", "serine 102"), ("c", "Thr12"), ("d", "S473 rose")], "record_id string, evidence_text string").write.parquet(str(tmp_path / "fewshot_pool.parquet"))
    got = {r[0]: r[1] for r in entry.queries()["c12_sites"](spark, str(tmp_path)).collect()}
    assert got == {"a": "Ser473", "b": "Ser102", "c": "Thr12"}
