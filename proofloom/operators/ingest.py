"""Nested statement documents into the relational model, set-based and idempotent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGENT = "name string, db_refs string"
_EVIDENCE = "source_api string, source_id string, pmid string, text string, source_hash bigint, epistemics struct<direct boolean, negated boolean, curated boolean>"
#: The fields of a statement document that the model needs.
DOCUMENT = (
    "type string, id string, matches_hash string, belief double, supports array<string>, supported_by array<string>, "
    + ", ".join(f"{r} struct<{_AGENT.replace(' string', ': string')}>" for r in ("enz", "sub", "subj", "obj", "agent"))
    + f", members array<struct<{_AGENT.replace(' string', ': string')}>>, evidence array<struct<{_EVIDENCE}>>"
)
#: A single object where ``DOCUMENT`` has an array.
_SINGLE = f"evidence struct<{_EVIDENCE}>, members struct<{_AGENT.replace(' string', ': string')}>"


def hex16(c: Column) -> Column:
    """A signed 64-bit number as 16 hex digits."""
    return F.lpad(F.lower(F.hex(c.cast("bigint"))), 16, "0")


def content_key(*cols: Column) -> Column:
    """The first 16 hex digits of the sha256 of the columns joined by |, nulls written as None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols]), 256), 1, 16)


def unwrapped(json_col: str) -> Column:
    """The JSON object of a text, all JSON strings around it taken off; null if it is not a valid object.

    A string around a string escapes its quotes, so a text has no more of them than its length has binary digits.
    """
    def inner(text: Column) -> Column:
        v = F.try_parse_json(text)
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(text)

    text = F.col(json_col)
    most = F.sequence(F.lit(0), F.ceil(F.log2(F.length(text) + 1)).cast("int"))
    text = F.when(text.rlike(r'^\s*"'), F.aggregate(most, text, lambda t, _: inner(t))).otherwise(text)
    return F.when(F.schema_of_variant(F.try_parse_json(text)).like("OBJECT%"), text)


def parsed(df: DataFrame, json_col: str = "raw_json") -> DataFrame:
    """Rows whose document is a valid JSON object, with the document parsed once as ``doc``; others are left out.

    A document inside a JSON string is that document, which replaces the string in ``json_col``; a single evidence or
    member where others have an array is an array of one.
    """
    x = df.withColumn(json_col, unwrapped(json_col)).filter(F.col(json_col).isNotNull()).withColumn("doc", F.from_json(json_col, DOCUMENT))
    rest = F.from_json(F.when(F.col("doc.evidence").isNull() | F.col("doc.members").isNull(), F.col(json_col)), _SINGLE)
    one = lambda k: F.coalesce(F.col(f"doc.{k}"), F.when(F.col(f"__one.{k}").isNotNull(), F.array(f"__one.{k}")))
    x = x.withColumn("__one", rest)
    return x.withColumn("doc", F.col("doc").withField("evidence", one("evidence")).withField("members", one("members"))).drop("__one")


def statements(docs: DataFrame) -> DataFrame:
    """One row a document: keys, type, belief (missing and 0 count as 1), numbers of supports."""
    return docs.select(
        hex16(F.col("doc.matches_hash")).alias("stmt_hash"),
        F.col("doc.id").alias("uuid"),
        F.col("doc.type").alias("stmt_type"),
        F.when(F.coalesce("doc.belief", F.lit(0.0)) == 0, 1.0).otherwise(F.col("doc.belief")).alias("belief"),
        F.size(F.coalesce("doc.supports", F.array().cast("array<string>"))).alias("supports_count"),
        F.size(F.coalesce("doc.supported_by", F.array().cast("array<string>"))).alias("supported_by_count"),
    )


def memberships(docs: DataFrame) -> DataFrame:
    """(stmt_hash, evidence_hash, evidence_index) by position; a missing source_hash is replaced by a content key."""
    e = docs.select(hex16(F.col("doc.matches_hash")).alias("stmt_hash"), F.posexplode("doc.evidence").alias("evidence_index", "e"))
    key = F.coalesce(hex16(F.col("e.source_hash")), content_key(F.col("e.source_api"), F.col("e.source_id"), F.col("e.pmid"), F.col("e.text")))
    return e.select("stmt_hash", key.alias("evidence_hash"), "evidence_index", "e")


def evidences(docs: DataFrame) -> DataFrame:
    """One row per evidence_hash, the largest of differing contents (so known values go before null), with the epistemic flags as three-valued booleans."""
    m = memberships(docs).select("evidence_hash", "e.source_api", "e.pmid", "e.text", "e.epistemics.direct", "e.epistemics.negated", "e.epistemics.curated")
    cols = m.columns[1:]
    return m.groupBy("evidence_hash").agg(F.max(F.struct(*cols)).alias("r")).select("evidence_hash", *[F.col(f"r.{c}").alias(c) for c in cols])


def agents(docs: DataFrame) -> DataFrame:
    """(stmt_hash, role, role_index, name): members, else enz and sub, else subj and obj, else agent; null slots give none."""
    def slot(role: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(0).alias("role_index"), F.col(f"doc.{role}.name").alias("name"), F.col(f"doc.{role}").isNotNull().alias("there"))

    members = F.transform("doc.members", lambda x, i: F.struct(F.lit("member").alias("role"), i.alias("role_index"), x["name"].alias("name"), x.isNotNull().alias("there")))
    has = lambda *r: reduce(lambda a, b: a | b, [F.col(f"doc.{x}").isNotNull() for x in r])
    slots = F.when(F.size("doc.members") > 0, members).when(has("enz", "sub"), F.array(slot("enz"), slot("sub"))).when(has("subj", "obj"), F.array(slot("subj"), slot("obj"))).otherwise(F.array(slot("agent")))
    return docs.select(hex16(F.col("doc.matches_hash")).alias("stmt_hash"), F.explode(slots).alias("s")).filter("s.there").select("stmt_hash", "s.role", "s.role_index", "s.name")


def edges(docs: DataFrame) -> DataFrame:
    """(from_hash, to_hash, kind): supports and supported_by, ids resolved to keys where a document has the id."""
    own = hex16(F.col("doc.matches_hash")).alias("from_hash")
    out = [docs.select(own, F.explode(f"doc.{k}").alias("to_id"), F.lit(k).alias("kind")) for k in ("supports", "supported_by")]
    known = docs.groupBy(F.col("doc.id").alias("to_id")).agg(F.min(hex16(F.col("doc.matches_hash"))).alias("to_key"))
    return out[0].unionByName(out[1]).distinct().join(known, "to_id", "left").select("from_hash", F.coalesce("to_key", "to_id").alias("to_hash"), "kind")


def labels(docs: DataFrame) -> DataFrame:
    """(target_kind, target_id, field, value): published belief per statement and the flags of every evidence."""
    b = statements(docs).select(F.lit("stmt").alias("target_kind"), F.col("stmt_hash").alias("target_id"), F.lit("belief").alias("field"), F.col("belief").cast("string").alias("value"))
    e = evidences(docs).selectExpr("'evidence' AS target_kind", "evidence_hash AS target_id", "stack(3, 'direct', cast(direct as string), 'negated', cast(negated as string), 'curated', cast(curated as string)) AS (field, value)")
    return b.unionByName(e.filter("value is not null")).distinct()


def conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Statements in both memberships whose sets of evidences differ: re-ingesting them would change a denominator."""
    def sets(df: DataFrame, name: str) -> DataFrame:
        x = df.select("stmt_hash", "evidence_hash").distinct().groupBy("stmt_hash")
        return x.agg(F.count("*").alias(f"{name}_n"), F.sum(F.xxhash64("evidence_hash").cast("decimal(38,0)")).alias(f"{name}_mark"))

    return sets(old, "old").join(sets(new, "new"), "stmt_hash").filter("old_n <> new_n or old_mark <> new_mark").select("stmt_hash", "old_n", "new_n")


def repeated(members: DataFrame) -> DataFrame:
    """(stmt_hash, evidence_hash, n): evidences that one document lists more than once."""
    return members.groupBy("stmt_hash", "evidence_hash").agg(F.countDistinct("evidence_index").alias("n")).filter("n > 1")


def denominators(statement_rows: DataFrame, members: DataFrame, json_col: str = "raw_json") -> DataFrame:
    """(stmt_hash, expected, stored) where the document's number of evidences differs from the stored memberships; a single evidence object counts 1."""
    single = F.from_json(json_col, "evidence struct<source_hash: bigint>")["evidence"].isNotNull()
    n = F.when(single, 1).otherwise(F.coalesce(F.json_array_length(F.get_json_object(json_col, "$.evidence")), F.lit(0)))
    want = statement_rows.groupBy("stmt_hash").agg(F.max(n).alias("expected"))
    have = members.groupBy("stmt_hash").agg(F.countDistinct("evidence_hash").alias("stored"))
    return want.join(have, "stmt_hash", "left").na.fill(0, ["stored"]).filter("expected <> stored")


def checked_labels(new: DataFrame, targets: DataFrame, key: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """The usable rows of ``new`` (target_id, field, value_text, ...), the last of each ``key``, and what was wrong.

    A row without target or field is dropped and counted; one whose target is not in ``targets`` (target_id) is kept
    and counted, since the target may come later. Of rows with the same key the largest value stays.
    """
    flags = new.agg(F.count("*").alias("rows"), F.count_if(F.coalesce("target_id", F.lit("")) == "").alias("no_target"), F.count_if(F.coalesce("field", F.lit("")) == "").alias("no_field")).first()
    ok = new.filter((F.coalesce("target_id", F.lit("")) != "") & (F.coalesce("field", F.lit("")) != ""))
    rest = [c for c in new.columns if c not in key]
    one = ok.groupBy(*key).agg(F.max(F.struct("value_text", *[c for c in rest if c != "value_text"])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
    unknown = one.select("target_id").distinct().join(targets.select("target_id"), "target_id", "left_anti").count()
    return one, {"rows": flags["rows"], "no_target": flags["no_target"], "no_field": flags["no_field"], "kept": one.count(), "unknown_targets": unknown}


def backfilled(df: DataFrame, json_col: str, fields: dict[str, str]) -> DataFrame:
    """``df`` with every column of ``fields`` that is null, empty or missing taken from its JSON path."""
    for c, path in fields.items():
        old = F.nullif(F.col(c), F.lit("")) if c in df.columns else F.lit(None).cast("string")
        df = df.withColumn(c, F.coalesce(old, F.get_json_object(json_col, path)))
    return df


def dropped_when_covered(df: DataFrame, column: str, key: list[str], members: DataFrame) -> DataFrame:
    """``df`` without ``column`` if ``members`` holds every (key, column) pair of it; otherwise a ValueError."""
    missing = df.filter(F.col(column).isNotNull()).join(members, [*key, column], "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"{column} holds pairs that the memberships lack")
    return df.drop(column)
