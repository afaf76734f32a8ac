"""The whole relation catalog."""

import pytest

import __spark_entry__ as entry
from proofloom.functions import catalog, textrules
from proofloom.sources.tables import table
from tests.conftest import rows

EXAMPLES = [
    ("MEK phosphorylates ERK on S218", ("mod_pos.active_verb", "modification", 1, "MEK", "ERK", "S218")),
    ("EGFR phosphorylation of SHC at serine 36", ("mod_pos.compound_nominal", "modification", 1, "EGFR", "SHC", "S36")),
    ("Akt, which in turn phosphorylates EphA2 on Ser-897", ("mod_pos.relative_clause", "modification", 1, "Akt", "EphA2", "S897")),
    ("RAF associates with RAS", ("bind.interacts_with", "binding", 0, "RAF", "RAS", None)),
    ("14-3-3 protein binding to Par1b", ("bind.gerund_modifier_to", "binding", 0, "14-3-3", "Par1b", None)),
    ("TNF stimulates CASP", ("act_pos.active_verb", "activity", 1, "TNF", "CASP", None)),
    ("TRAIL-induced activation of caspase-3 and caspase-9", ("act_pos.x_induced_act_of_coord_last", "activity", 1, "TRAIL", "caspase-9", None)),
    ("PTEN suppresses AKT signaling", ("act_neg.verb_y_activation", "activity", -1, "PTEN", "AKT", None)),
    ("p53 also induces the expression of GLS2", ("amt_pos.x_induces_expression_of_y", "amount", 1, "p53", "GLS2", None)),
    ("AB1 docks onto CD2", ("binds", "binding", 0, "AB1", "CD2", None)),
]


@pytest.mark.parametrize(("text", "found"), EXAMPLES)
def test_patterns(text, found):
    assert found in catalog.matches(text) and catalog.matches(text) == catalog.matches(text, quick=False)


def test_catalog_is_whole_and_takes_odd_texts():
    assert len(catalog.PATTERNS) == 48 and len({n for n, *_ in catalog.PATTERNS}) == 48
    assert [catalog.matches(t) for t in (None, "", "...", "EGFR activates EGFR")] == [[], [], [], []]
    assert [catalog.site_of(s) for s in (None, "Y-0", "Thr-461", "tyrosine  7", "yr5")] == [None, None, "T461", "Y7", None]


def test_query_has_all_rows_of_the_sentence_forms(spark, folder):
    new = entry.queries()["c10_relations"](spark, folder)
    old = textrules.relations(table(spark, folder, "evidence"), "evidence_hash", "text").distinct()
    got, nine = set(rows(new.select(old.columns))), set(rows(old))
    assert nine < got and new.filter("relation like 'mod_pos.%' and site is not null").count() > 0
