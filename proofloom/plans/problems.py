"""Queries p3 and p4: nested records as flat tables, and references to records that do not exist."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions.text import key
from proofloom.lineage import cut
from proofloom.operators import nested
from proofloom.operators.nested import flatten
from proofloom.operators.references import orphans
from proofloom.sources.tables import table


def p3_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every nested item of statement, evidence and agent documents, with its variant and its parent's path."""
    agent = table(spark, folder, "agent")
    slot = F.concat_ws(":", key("stmt_hash"), F.coalesce("role", F.lit("")), F.coalesce(F.col("role_index").cast("string"), F.lit("")))
    parts = [
        flatten(table(spark, folder, "statement"), "statement", "stmt_hash", "raw_json", "statement"),
        flatten(table(spark, folder, "evidence"), "evidence", "evidence_hash", "raw_json", "evidence"),
        flatten(agent, "agent", F.when(key("stmt_hash").isNotNull(), slot), "db_refs_json", "db_refs"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _typed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The typed table of every structural variant, from one pass over the documents."""
    nodes = cut(p3_nodes(spark, folder), by=["variant"])
    return {v: nested.typed(nodes, v) for v in nested.TYPED}


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct nested items: the union of the typed tables over their common columns.

    A record loaded twice gives its items once.
    """
    return nested.common(_typed(spark, folder)).select("source_table", "parent_key", "child_path", "child_value").distinct()


def p3_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Items, parents and distinct paths of every structural variant."""
    x = nested.common(_typed(spark, folder)).select("source_table", "variant", "parent_key", "child_path").distinct()
    return x.groupBy("source_table", "variant").agg(F.count("*").alias("items"), F.countDistinct("parent_key").alias("parents"), F.countDistinct("child_path").alias("paths"))


def p3_agents(spark: SparkSession, folder: str) -> DataFrame:
    """The typed table of agents: role and name, linked to the statement or to the agent each is bound to."""
    return _typed(spark, folder)["agent"].distinct()


def p3_db_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The typed table of database ids: namespace, id and score."""
    return _typed(spark, folder)["db_id"].distinct()


def p3_text_refs(spark: SparkSession, folder: str) -> DataFrame:
    """The typed table of text references: kind and id."""
    return _typed(spark, folder)["text_ref"].distinct()


#: Referring table, its field, the table it points to, that table's key.
REFERENCES = [
    ("statement_evidence", "stmt_hash", "statement", "stmt_hash"),
    ("statement_evidence", "evidence_hash", "evidence", "evidence_hash"),
    ("agent", "stmt_hash", "statement", "stmt_hash"),
]


def p4_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """The orphan references of every REFERENCES entry, with their cause."""
    out = []
    notices = table(spark, folder, "deleted_key")
    for ref, field, parent, parent_key in REFERENCES:
        r = table(spark, folder, ref).select(key(field).alias("k"), "loaded_at")
        p = table(spark, folder, parent).select(key(parent_key).alias("k"), "loaded_at")
        d = notices.filter(F.col("table_name") == parent).select(key("key_value").alias("k"), "deleted_at")
        x = orphans(r, ["k"], p, ["k"], "simple", "loaded_at", "loaded_at", d, "deleted_at")
        out.append(x.select(F.lit(ref).alias("ref_table"), F.lit(field).alias("ref_field"), "period", F.col("k").alias("ref_key"), "cause"))
    return reduce(DataFrame.unionByName, out)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every orphan key of a month, once."""
    return p4_orphans(spark, folder).drop("cause")


def p4_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Memberships whose (stmt_hash, source_dump_id) no statement row has, under partial and full match semantics."""
    pair = [key(c).alias(c) for c in ("stmt_hash", "source_dump_id")]
    r = table(spark, folder, "statement_evidence").select(*pair, "loaded_at")
    p = table(spark, folder, "statement").select(*pair)
    out = [orphans(r, p.columns, p, p.columns, match, "loaded_at").withColumn("match", F.lit(match)) for match in ("partial", "full")]
    return reduce(DataFrame.unionByName, out)


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan keys per table, field, month and cause."""
    return p4_orphans(spark, folder).groupBy("ref_table", "ref_field", "period", "cause").agg(F.count("*").alias("orphan_keys"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_nodes, p3_variants, p3_agents, p3_db_ids, p3_text_refs, p4_found, p4_composite, p4_report)}


def _clean(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"


_ORPHANS = " UNION ALL ".join(
    f"""SELECT '{ref}' AS ref_table, '{field}' AS ref_field, strftime(r.loaded_at, '%Y-%m') AS period, r.k AS ref_key,
      min(CASE WHEN p.k IS NULL THEN 'missing' WHEN p.f > r.t THEN 'early' WHEN d.d >= p.l THEN 'deleted' END) AS cause
    FROM (SELECT {_clean(field)} AS k, loaded_at, min(loaded_at) OVER (PARTITION BY {_clean(field)}, strftime(loaded_at, '%Y-%m')) AS t FROM {ref}) r
    LEFT JOIN (SELECT {_clean(pk)} AS k, min(loaded_at) AS f, max(loaded_at) AS l FROM {parent} GROUP BY 1) p ON p.k = r.k
    LEFT JOIN (SELECT {_clean('key_value')} AS k, max(deleted_at) AS d FROM deleted_key WHERE table_name = '{parent}' GROUP BY 1) d ON d.k = r.k
    WHERE r.k IS NOT NULL AND (p.k IS NULL OR p.f > r.t OR d.d >= p.l)
    GROUP BY 1, 2, 3, 4"""
    for ref, field, parent, pk in REFERENCES
)
_PAIRS = f"""r AS (SELECT DISTINCT {_clean('stmt_hash')} AS a, {_clean('source_dump_id')} AS b, strftime(loaded_at, '%Y-%m') AS period FROM statement_evidence),
  p AS (SELECT DISTINCT {_clean('stmt_hash')} AS a, {_clean('source_dump_id')} AS b FROM statement)"""


def _documents(t: str, k: str, c: str) -> str:
    """Key and document of a table; a document in a JSON string counts as itself."""
    once = "CASE WHEN json_type({0}) = 'VARCHAR' THEN TRY_CAST({0} ->> '$' AS JSON) ELSE {0} END"
    j = f"TRY_CAST({c} AS JSON)"
    for i in range(2):
        j = f"(SELECT {once.format(f'x{i}')} FROM (SELECT {j} AS x{i}))"
    return f"SELECT {k} AS parent_key, {j} AS j FROM {t} WHERE {k} IS NOT NULL AND {c} <> ''"


_SLOT = f"""{_clean('stmt_hash')} || ':' || coalesce(role, '') || ':' || coalesce(CAST(role_index AS VARCHAR), '')"""
# a path as keys and positions parted by dots, where a single object that stands for an array gets the position 0
_PATH = r"""regexp_replace(regexp_replace(regexp_replace(substr(fullkey, 3), '\[(\d+)\]', '.\1', 'g'), '(members|bound_conditions|evidence|raw_text)\.([^\d])', '\1.0.\2', 'g'), '(members|bound_conditions|evidence|raw_text)$', '\1.0')"""
_SCALAR = "type NOT IN ('OBJECT', 'ARRAY', 'NULL')"
_NESTED = rf"""SELECT 'statement' AS source_table, parent_key, {_PATH} AS child_path, value ->> 'name' AS child_value, 'agent' AS variant, CAST(NULL AS DOUBLE) AS score
    FROM ({_documents('statement', 'stmt_hash', 'raw_json')}) d, json_tree(d.j) WHERE type = 'OBJECT' AND fullkey <> '$' AND NOT starts_with(fullkey, '$.evidence')
  UNION ALL SELECT 'statement', parent_key, {_PATH}, value ->> 'source_hash', 'evidence', NULL
    FROM ({_documents('statement', 'stmt_hash', 'raw_json')}) d, json_tree(d.j) WHERE type = 'OBJECT' AND regexp_matches(fullkey, '^\$\.evidence(\[\d+\])?$')
  UNION ALL SELECT 'evidence', parent_key, {_PATH}, value ->> '$', 'text_ref', NULL
    FROM ({_documents('evidence', 'evidence_hash', 'raw_json')}) d, json_tree(d.j) WHERE {_SCALAR} AND regexp_matches(fullkey, '^\$\.text_refs\.[^.\[]+(\[\d+\])?$')
  UNION ALL SELECT 'evidence', parent_key, {_PATH}, value ->> '$', 'raw_text', NULL
    FROM ({_documents('evidence', 'evidence_hash', 'raw_json')}) d, json_tree(d.j) WHERE {_SCALAR} AND regexp_matches(fullkey, '^\$\.annotations\.agents\.raw_text(\[\d+\])?$')
  UNION ALL SELECT 'agent', parent_key, CASE WHEN path = '$' THEN key || '.0' ELSE {_PATH} END, CASE WHEN type = 'ARRAY' THEN value ->> 0 ELSE value ->> '$' END, 'db_id', CASE WHEN type = 'ARRAY' THEN CAST(value ->> 1 AS DOUBLE) END
    FROM (SELECT * FROM ({_documents('agent', _SLOT, 'db_refs_json')}) d, json_tree(d.j))
    WHERE path = '$' AND (type = 'ARRAY' AND json_array_length(value) = 2 AND json_type(value, '$[0]') = 'VARCHAR' AND json_type(value, '$[1]') = 'DOUBLE' OR {_SCALAR})
      OR regexp_matches(fullkey, '^\$\.[^.\[]+\[\d+\]$') AND type NOT IN ('OBJECT', 'NULL')"""
_ITEMS = f"SELECT DISTINCT * FROM ({_NESTED}) WHERE child_value <> ''"
ORACLE = {
    "p4_found": f"SELECT ref_table, ref_field, period, ref_key FROM ({_ORPHANS})",
    "p3_found": f"SELECT DISTINCT source_table, parent_key, child_path, child_value FROM ({_ITEMS})",
    "p3_agents": rf"""SELECT source_table, parent_key, child_path, regexp_extract(child_path, '^(.*)\.bound_conditions\.\d+\.agent$', 1) AS parent_path,
      CASE WHEN regexp_matches(child_path, '\.\d+$') THEN CAST(regexp_extract(child_path, '(\d+)$', 1) AS INT) ELSE 0 END AS position,
      regexp_extract(child_path, '([^.]*[^.\d])(\.\d+)?$', 1) AS role, child_value AS name FROM ({_ITEMS}) WHERE variant = 'agent'""",
    "p3_db_ids": rf"""SELECT source_table, parent_key, child_path, split_part(child_path, '.', 1) AS parent_path, CAST(regexp_extract(child_path, '(\d+)$', 1) AS INT) AS position,
      split_part(child_path, '.', 1) AS namespace, child_value AS db_id, score FROM ({_ITEMS}) WHERE variant = 'db_id'""",
    "p3_text_refs": rf"""SELECT source_table, parent_key, child_path, 'text_refs' AS parent_path, coalesce(TRY_CAST(split_part(child_path, '.', 3) AS INT), 0) AS position,
      split_part(child_path, '.', 2) AS ref_type, child_value AS ref_id FROM ({_ITEMS}) WHERE variant = 'text_ref'""",
    "p3_variants": f"SELECT source_table, variant, count(DISTINCT (parent_key, child_path)) AS items, count(DISTINCT parent_key) AS parents, count(DISTINCT child_path) AS paths FROM ({_ITEMS}) GROUP BY ALL",
    "p4_composite": f"""WITH {_PAIRS}
      SELECT a AS stmt_hash, b AS source_dump_id, period, 'missing' AS cause, 'partial' AS match FROM r
      WHERE (a IS NOT NULL OR b IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM p WHERE (r.a IS NULL OR p.a = r.a) AND (r.b IS NULL OR p.b = r.b))
      UNION ALL SELECT a, b, period, CASE WHEN a IS NULL OR b IS NULL THEN 'partly_null' ELSE 'missing' END, 'full' FROM r
      WHERE (a IS NOT NULL OR b IS NOT NULL) AND (a IS NULL OR b IS NULL OR NOT EXISTS (SELECT 1 FROM p WHERE p.a = r.a AND p.b = r.b))""",
    "p4_report": f"SELECT ref_table, ref_field, period, cause, count(*) AS orphan_keys FROM ({_ORPHANS}) GROUP BY ALL",
}
