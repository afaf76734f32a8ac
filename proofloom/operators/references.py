"""References to records that do not exist: anti-joins by null mask under declared match semantics."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.lineage import cut
from proofloom.operators.skew import bounded_broadcast

MATCH = ("simple", "partial", "full")


def orphans(
    refs: DataFrame,
    ref_cols: list[str],
    parent: DataFrame,
    parent_cols: list[str],
    match: str = "simple",
    at: str | None = None,
    parent_at: str | None = None,
    deleted: DataFrame | None = None,
    deleted_at: str | None = None,
) -> DataFrame:
    """The references (``ref_cols``, and the month of ``at`` as ``period``) that point to no living record.

    References are grouped by their null mask: for every combination of null and non-null key columns one anti-join
    is made on the non-null columns. ``match`` follows SQL: simple - a key with any null refers to nothing and is
    never an orphan; partial - the non-null columns must be found together in some parent row; full - a key that is
    partly null is always an orphan. A key whose columns are all null is no reference under any of the three.

    A complete key is also an orphan if its first parent row is later than the reference (``at``, ``parent_at``), or
    if ``deleted`` (the columns ``parent_cols`` and ``deleted_at``) has a notice not earlier than the key's last
    parent row. References are combined to one row per key and month, with their earliest time, before any shuffle
    join, so a key that a third of all rows hold costs one row per task. Result: distinct rows of ``ref_cols``,
    ``period`` (null for references without a time) and ``cause`` (missing, early, deleted, partly_null). Columns of
    other names are ignored, empty tables give an empty result, repeated rows count once.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    k = len(ref_cols)
    ks = [f"k{i}" for i in range(k)]
    when = F.col(at) if at else F.lit(None).cast("timestamp")
    r = refs.select(*[F.col(c).alias(x) for c, x in zip(ref_cols, ks)], F.date_format(when, "yyyy-MM").alias("period"), when.alias("t"))
    r = r.groupBy(*ks, "period").agg(F.min("t").alias("t"))
    loaded = F.col(parent_at) if parent_at else F.lit(None).cast("timestamp")
    p = parent.select(*[F.col(c).alias(x) for c, x in zip(parent_cols, ks)], loaded.alias("l")).groupBy(*ks).agg(F.min("l").alias("first"), F.max("l").alias("last"))
    out = []
    for mask in product((False, True), repeat=k):
        here = [x for x, null in zip(ks, mask) if not null]
        if not here or (match == "simple" and any(mask)):
            continue
        mine = r.filter(reduce(lambda a, b: a & b, [F.col(x).isNull() if null else F.col(x).isNotNull() for x, null in zip(ks, mask)]))
        if not any(mask):
            x = mine.join(p.withColumn("found", F.lit(True)), ks, "left")
            gone = F.lit(False)
            if deleted is not None:
                d = deleted.select(*[F.col(c).alias(y) for c, y in zip(parent_cols, ks)], F.col(deleted_at).alias("d")).groupBy(*ks).agg(F.max("d").alias("d"))
                x = x.join(bounded_broadcast(cut(d)), ks, "left")
                gone = F.col("d") >= F.col("last")
            cause = F.when(F.col("found").isNull(), "missing").when(F.col("first") > F.col("t"), "early").when(gone, "deleted")
            out.append(x.select(*ks, "period", cause.alias("cause")).filter("cause is not null"))
        elif match == "full":
            out.append(mine.select(*ks, "period", F.lit("partly_null").alias("cause")))
        else:
            some = p.select(*here).distinct()
            out.append(mine.join(some, here, "left_anti").select(*ks, "period", F.lit("missing").alias("cause")))
    if not out:
        return refs.sparkSession.createDataFrame([], ", ".join(f"`{c}` string" for c in ref_cols) + ", period string, cause string")
    both = reduce(DataFrame.unionByName, out)
    return both.select(*[F.col(x).alias(c) for x, c in zip(ks, ref_cols)], "period", "cause")
