"""The whole relation catalog: 48 surface patterns in five groups, and the nine sentence forms of ``textrules``.

Python runs here because the patterns are matched as Python's ``re`` matches them (Unicode words, letter case ignored).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.functions import textrules
from proofloom.operators.skew import spread_out

_NAME = r"[A-Za-z\d][\w/.-]*\w"
_X, _Y = rf"(?P<X>{_NAME})", rf"(?P<Y>{_NAME})"
_SITE = r"(?:[STYsty]-?\d+|[Ss]er-?\d+|[Tt]hr-?\d+|[Yy]r?-?\d+|[Tt]yr-?\d+|serine\s+\d+|threonine\s+\d+|tyrosine\s+\d+)"
_AT = rf"(?:\s+(?:on|at)\s+(?P<site>{_SITE}))?"
_MOD = r"(?:phosphorylat|acetylat|methylat|ubiquitinat|sumoylat|hydroxylat|glycosylat|palmitoylat|farnesylat|prenylat|nitrosylat|polyubiquitinat|deacetylat|demethylat|deubiquitinat|dephosphorylat)"
_MOD_VERB, _MOD_NOUN = rf"{_MOD}(?:es|ed|ing|e)?", rf"{_MOD}ion"
_ACT = r"(?:activat|stimulat|induc|trigger|elicit|provok|initiat|promot)"
_ACT_VERB, _ACT_NOUN = rf"{_ACT}(?:es|ed|ing|e)?", r"(?:activation|stimulation|induction|promotion)"
_NEG = r"(?:decreas|reduc|inhibit|abolish|suppress|diminish|attenuat|block)"
_NEG_VERB, _NEG_NOUN = rf"{_NEG}(?:s|es|ed|ing|e)?", r"(?:decrease|reduction|inhibition|suppression|attenuation|blockade)"
_ADVERB = r"(?:\s+(?:also|then|further|subsequently|directly|here|moreover|in\s+turn))?"
_DRIVEN = r"(?:induced|mediated|driven|dependent|stimulated|triggered)"
_RELEASE = r"(?:-induced|\s+induced|\s+stimulates?|\s+stimulated|\s+triggered)\s+(?:the\s+)?(?:release|secretion|production)\s+of\s+"
_RAISES = r"(?:induces?|increases?|enhances?|upregulates?|stimulates?|elevates?)"
_COORD = r"[\w-]+(?:\s*,\s*[\w-]+){0,3}\s+(?:and|or)\s+"
_PRODUCT = r"(?:expression|production|levels?|abundance|secretion|release)"
_DOING = r"(?:activation|signaling|activity)"

# Texts of which a pattern needs one of each group; only a faster way to tell most misses.
_mod, _act, _act_noun, _made = ("ylat", "ubiquitinat"), ("activat", "stimulat", "induc", "trigger", "elicit", "provok", "initiat", "promot"), ("activation", "stimulation", "induction", "promotion"), ("release", "secretion", "production")
_doing, _neg, _neg_noun, _driven = ("activation", "signaling", "activity"), ("decreas", "reduc", "inhibit", "abolish", "suppress", "diminish", "attenuat", "block"), ("decrease", "reduction", "inhibition", "suppression", "attenuation", "blockade"), ("-induced", "-mediated", "-driven", "-dependent", "-stimulated", "-triggered")
_up, _raises, _product, _dimer = ("regulate", "increase", "enhance", "elevate", "augment", "amplif", "boost"), ("induce", "increase", "enhance", "upregulate", "stimulate", "elevate"), ("expression", "production", "level", "abundance", "secretion", "release"), ("complex", "dimer", "heterotrimer")

#: Pattern id, sign, pattern with the groups X (agent), Y (target) and, of a modification, site; needed texts.
PATTERNS = [
    ("mod_pos.active_verb", 1, rf"\b{_X}\s+(?:kinase[s]?\s+)?{_MOD_VERB}\s+{_Y}{_AT}", [_mod]),
    ("mod_pos.passive_by", 1, rf"\b{_Y}\s+(?:was|is|were|are|gets?|got|been)\s+(?:{_MOD}ed)\s+by\s+{_X}", [_mod, ("by",)]),
    ("mod_pos.nominalized_by", 1, rf"\b{_MOD_NOUN}\s+of\s+{_Y}{_AT}\s+by\s+{_X}", [_mod, ("by",)]),
    ("mod_pos.induced_adj", 1, rf"\b{_X}-induced\s+{_Y}\s+{_MOD_NOUN}", [_mod, ("-induced",)]),
    ("mod_pos.mediated_adj", 1, rf"\b{_X}-mediated\s+{_Y}\s+{_MOD_NOUN}", [_mod, ("-mediated",)]),
    ("mod_pos.dependent_of", 1, rf"\b{_X}[ -]dependent\s+{_MOD_NOUN}\s+of\s+{_Y}{_AT}", [_mod, ("dependent",)]),
    ("mod_pos.compound_nominal", 1, rf"\b{_X}\s+{_MOD_NOUN}\s+of\s+{_Y}{_AT}", [_mod, ("of",)]),
    ("mod_pos.target_compound_by", 1, rf"\b{_Y}\s+{_MOD_NOUN}\s+by\s+{_X}{_AT}", [_mod, ("by",)]),
    ("mod_pos.x_increases_phos_of_y", 1, rf"\b{_X}{_ADVERB}\s+(?:increases?|enhances?|elevates?|induces?|promotes?|drives?|stimulates?)\s+(?:the\s+)?{_MOD_NOUN}\s+of\s+{_Y}{_AT}", [_mod, ("increase", "enhance", "elevate", "induce", "promote", "drive", "stimulate")]),
    ("mod_pos.relative_clause", 1, rf"\b{_X},?\s+which\s+(?:in\s+turn\s+|then\s+|subsequently\s+|directly\s+)?{_MOD_VERB}\s+{_Y}{_AT}", [_mod, ("which",)]),
    ("bind.active_verb", 0, rf"\b{_X}\s+binds?\s+(?:to\s+)?{_Y}", [("bind",)]),
    ("bind.binding_of_to", 0, rf"\bbinding\s+of\s+{_X}\s+to\s+{_Y}", [("binding",)]),
    ("bind.interacts_with", 0, rf"\b{_X}\s+(?:interact[s]?|associates?|coimmunoprecipitates?|co-immunoprecipitates?|co-localizes?)\s+with\s+{_Y}", [("interact", "associate", "immunoprecipitate", "co-localize"), ("with",)]),
    ("bind.complex_of", 0, rf"\bcomplex\s+(?:of|between)\s+{_X}\s+and\s+{_Y}", [("complex",), ("and",)]),
    ("bind.interaction_compound", 0, rf"\b{_X}[/\-]{_Y}\s+(?:interaction|complex|binding|heterodimer)", [("interaction", "complex", "binding", "heterodimer"), ("-", "/")]),
    ("bind.between_and", 0, rf"\binteraction\s+between\s+{_X}\s+and\s+{_Y}", [("interaction",), ("between",)]),
    ("bind.recruits", 0, rf"\b{_X}\s+(?:recruits?|tethers?|anchors?)\s+{_Y}", [("recruit", "tether", "anchor")]),
    ("bind.gerund_to", 0, rf"\b{_X}\s+binding\s+to\s+{_Y}", [("binding",)]),
    ("bind.possessive_interaction", 0, rf"\b{_X}['']s\s+interactions?\s+with\s+{_Y}", [("interaction",), ("'s",)]),
    ("bind.forms_complex_with", 0, rf"\b{_X}\s+forms?\s+(?:an?\s+)?(?:complex|heterodimer|dimer|heterotrimer)\s+with\s+{_Y}", [_dimer, ("form",), ("with",)]),
    ("bind.coord_complex", 0, rf"\b{_X}\s+(?:and|with)\s+{_Y}\s+(?:complex|heterodimer|dimer|heterotrimer|interaction)(?:\s+(?:formation|interaction|binding|formation))?", [(*_dimer, "interaction"), ("and", "with")]),
    ("bind.binding_affinity_for", 0, rf"\bbinding\s+(?:affinity\s+)?of\s+{_X}\s+(?:for|to)\s+{_Y}", [("binding",)]),
    ("bind.bound_to", 0, rf"\b{_X}\s+bound\s+(?:tightly\s+|directly\s+|strongly\s+)?to\s+{_Y}", [("bound",)]),
    ("bind.passive_associated", 0, rf"\b{_X}\s+(?:is|are|was|were)\s+(?:directly\s+|stably\s+|tightly\s+|physically\s+)?(?:associated|complexed|conjugated|coupled|linked)\s+with\s+{_Y}", [("associated", "complexed", "conjugated", "coupled", "linked"), ("with",)]),
    ("bind.coord_bound_to", 0, rf"\b\w+\s+and\s+{_X}\s+bound\s+to\s+{_Y}", [("bound",), ("and",)]),
    ("bind.gerund_modifier_to", 0, rf"\b{_X}\s+(?:protein\s+|family\s+|complex\s+)binding\s+to\s+{_Y}", [("binding",), ("protein", "family", "complex")]),
    ("act_pos.active_verb", 1, rf"\b{_X}\s+{_ACT_VERB}\s+{_Y}", [_act]),
    ("act_pos.induced_adj", 1, rf"\b{_X}-induced\s+{_Y}\s+{_ACT_NOUN}", [_act_noun, ("-induced",)]),
    ("act_pos.mediated_adj", 1, rf"\b{_X}-mediated\s+{_Y}\s+{_ACT_NOUN}", [_act_noun, ("-mediated",)]),
    ("act_pos.nominalized_by", 1, rf"\b{_ACT_NOUN}\s+of\s+{_Y}\s+by\s+{_X}", [_act_noun, ("by",)]),
    ("act_pos.compound_nominal", 1, rf"\b{_X}\s+{_ACT_NOUN}\s+of\s+{_Y}", [_act_noun, ("of",)]),
    ("act_pos.triggered_act", 1, rf"\b{_X}\s+(?:triggered|induced|stimulated|drives|drove)\s+(?:the\s+)?{_ACT_NOUN}\s+of\s+{_Y}", [_act_noun, ("triggered", "induced", "stimulated", "drives", "drove")]),
    ("act_pos.x_induced_act_of_y", 1, rf"\b{_X}-{_DRIVEN}\s+{_ACT_NOUN}\s+of\s+{_Y}", [_act_noun, _driven]),
    ("act_pos.x_induced_act_of_coord_last", 1, rf"\b{_X}-{_DRIVEN}\s+{_ACT_NOUN}\s+of\s+{_COORD}{_Y}", [_act_noun, _driven]),
    ("act_pos.x_induced_release_of", 1, rf"\b{_X}{_RELEASE}{_Y}", [_made, ("induced", "stimulate", "triggered")]),
    ("act_pos.x_induced_release_coord_last", 1, rf"\b{_X}{_RELEASE}{_COORD}{_Y}", [_made, ("induced", "stimulate", "triggered")]),
    ("act_neg.verb_activation_of", -1, rf"\b{_X}\s+{_NEG_VERB}\s+(?:the\s+)?{_DOING}\s+of\s+{_Y}", [_neg, _doing]),
    ("act_neg.verb_y_activation", -1, rf"\b{_X}\s+{_NEG_VERB}\s+{_Y}\s+{_DOING}", [_neg, _doing]),
    ("act_neg.nominalized_by", -1, rf"\b{_NEG_NOUN}\s+(?:in|of)\s+{_Y}\s+{_DOING}\s+by\s+{_X}", [_neg_noun, _doing, ("by",)]),
    ("act_neg.mediated_decrease", -1, rf"\b{_X}-mediated\s+{_NEG_NOUN}\s+(?:in|of)\s+{_Y}\s+{_DOING}", [_neg_noun, _doing, ("-mediated",)]),
    ("amt_pos.upregulates", 1, rf"\b{_X}\s+(?:upregulates?|up-regulates?|increases?|enhances?|elevates?|augments?|amplifies?|boosts?)\s+{_Y}(?:\s+(?:expression|levels|amount[s]?|production|abundance|protein))?", [_up]),
    ("amt_pos.induces_expression", 1, rf"\b{_X}\s+induces?\s+{_Y}\s+(?:expression|production|levels|protein)", [("induce",), ("expression", "production", "levels", "protein")]),
    ("amt_pos.passive_upregulated", 1, rf"\b{_Y}\s+(?:expression|levels?|amount[s]?|production)?\s*(?:is|was|are|were)\s+(?:upregulated|up-regulated|increased|elevated|enhanced|induced|augmented|elevated)\s+by\s+{_X}", [("regulated", "increased", "elevated", "enhanced", "induced", "augmented"), ("by",)]),
    ("amt_pos.induced_adj", 1, rf"\b{_X}-induced\s+{_Y}\s+(?:expression|production|levels?)", [("-induced",), ("expression", "production", "level")]),
    ("amt_pos.required_to_elevate", 1, rf"\b{_X}.{{0,40}}required\s+to\s+(?:elevate|increase|induce|upregulate|enhance)\s+{_Y}", [("required",)]),
    ("amt_pos.x_induces_expression_of_y", 1, rf"\b{_X}{_ADVERB}\s+(?:induces?|increases?|enhances?|elevates?|upregulates?|up-regulates?|drives?|promotes?)\s+(?:the\s+)?(?:expression|production|levels?|abundance|transcription)\s+of\s+{_Y}", [("expression", "production", "level", "abundance", "transcription"), ("induce", "increase", "enhance", "elevate", "regulate", "drive", "promote")]),
    ("amt_pos.coord_first", 1, rf"\b{_X}\s+{_RAISES}\s+{_Y}(?:\s*,\s*[\w-]+){{0,3}}\s+(?:and|or)\s+[\w-]+\s+{_PRODUCT}", [_raises, _product]),
    ("amt_pos.coord_last", 1, rf"\b{_X}\s+{_RAISES}\s+{_COORD}{_Y}\s+{_PRODUCT}", [_raises, _product]),
]
_AXES = {"mod": "modification", "bind": "binding", "act": "activity", "amt": "amount"}
#: The axis of the sentence forms.
FORMS = {"activates": "activity", "inhibits": "activity", "blocked_by": "activity", "phosphorylates": "modification", "phosphorylated_by": "modification", "binds": "binding", "raises": "amount", "induced_by": "amount", "repressed_by": "amount"}
# Name, axis, sign, compiled pattern, groups of agent and target, whether it has a site, needed texts.
_ALL = [(n, _AXES[n.split(".")[0].split("_")[0]], sg, c := re.compile(p, re.IGNORECASE), "X", "Y", "site" in c.groupindex, needs) for n, sg, p, needs in PATTERNS]
_ALL += [(n, FORMS[n], sg, re.compile(p, re.ASCII), a, b, False, []) for n, sg, p, a, b in textrules.CATALOG]
_SITE_PARTS = re.compile(r"(s|t|y|serine|threonine|tyrosine|ser|thr|tyr)(?:-?|\s+)(\d+)", re.IGNORECASE)


def site_of(found: str | None) -> str | None:
    """A captured site as letter and position (S102); none of what names no residue or a position beyond 1 to 9999."""
    m = _SITE_PARTS.fullmatch(found) if found else None
    return f"{'Y' if m[1].lower().startswith('ty') else m[1][0].upper()}{int(m[2])}" if m and 0 < int(m[2]) <= 9999 else None


def matches(text: str | None, quick: bool = True) -> list[tuple]:
    """(relation, axis, sign, agent, target, site) of every pattern's matches, each once; an agent that is its target is left out.

    ``quick`` skips patterns whose needed texts an ASCII text lacks, which can't change the result.
    """
    if not text:
        return []
    low = text.lower() if quick and text.isascii() else None
    out: dict[tuple, None] = {}
    for name, axis, sign, pattern, a, b, sited, needs in _ALL:
        if low is not None and not all(any(w in low for w in group) for group in needs):
            continue
        for m in pattern.finditer(text):
            if m[a] != m[b]:
                out[name, axis, sign, m[a], m[b], site_of(m["site"]) if sited else None] = None
    return list(out)


def relations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, relation, axis, sign, agent, target, site): ``matches`` of every row's text, in one Arrow pass."""
    schema = pa.schema([(key, pa.string()), ("relation", pa.string()), ("axis", pa.string()), ("sign", pa.int32()), ("agent", pa.string()), ("target", pa.string()), ("site", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in matches(t)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found) if found else [[]] * len(schema), schema)], schema=schema)

    x = texts.select(F.col(key).cast("string"), text).filter(F.col(text).isNotNull())
    return spread_out(x).mapInArrow(rows, f"{key} string, relation string, axis string, sign int, agent string, target string, site string")
