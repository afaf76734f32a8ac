"""Samples that match target proportions, by divisor-method priorities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.lineage import cut
from proofloom.operators.skew import bounded_broadcast, ranked


def label(c: Column | str) -> Column:
    """A category regardless of letter case, outer blanks and whether _, - or blanks part its words."""
    x = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), r"[_\-\s]+", "_")


def _required(t: DataFrame) -> DataFrame:
    need = F.floor(F.col("target_share") * F.col("sample_size") + F.lit(0.5 + 1e-9)).cast("bigint")
    return t.select("category_field", "category", label("category").alias("c"), "target_share", "min_rows", "sample_size", need.alias("quota"), F.greatest(need, F.col("min_rows").cast("bigint")).alias("required"))


def _units(pool: DataFrame, unit: str, fields: list[str], targets: DataFrame) -> DataFrame:
    """Distinct (category_field, c, unit) of the categories that have a target."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("category_field"), label(f).alias("c")) for f in fields])).alias("p")
    x = pool.filter(F.col(unit).isNotNull()).select(F.col(unit).alias("unit"), pairs).select("unit", "p.*").filter("c is not null")
    return x.join(bounded_broadcast(targets.select("category_field", "c").distinct()), ["category_field", "c"]).distinct()


def chance(unit: Column | str, seed: int) -> Column:
    """A seeded random number of a unit: 60 bits of the digest of its text, the same in every engine."""
    u = F.col(unit) if isinstance(unit, str) else unit
    return F.conv(F.substring(F.md5(F.concat_ws("|", u.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")


def queues(pool: DataFrame, unit: str, fields: list[str], targets: DataFrame, seed: int = 7) -> DataFrame:
    """The ranked and floored units of every category: the one written table that is drawn from and reported on.

    In each category the units are numbered in random (seeded hash) order; rank r has the priority
    (r - 0.5) / target_share, and the first min_rows units are floors. Columns: category_field, category, c, unit,
    rank, floor, priority and those of the target. Null units and null categories, and categories without a target,
    are left out; a target share of 0 has infinite priorities behind its floor.
    """
    t = cut(_required(targets))
    order = F.shiftleft(chance("unit", seed), 3)
    units = ranked(_units(pool, unit, fields, t), ["category_field", "c"], order)
    x = units.join(bounded_broadcast(t), ["category_field", "c"])
    x = x.withColumn("floor", F.coalesce(F.col("rank") <= F.col("min_rows"), F.lit(False)))
    return cut(x.withColumn("priority", _priority(F.col("rank"))))


def _priority(rank: Column) -> Column:
    return F.when(F.col("target_share") > 0, (rank - 0.5) / F.col("target_share")).otherwise(F.lit(float("inf")))


def drawn(queue: DataFrame) -> DataFrame:
    """``queue`` (see ``queues``) cut to the drawn units: of every field the sample_size first by floor and priority.

    Seats of an exhausted category go to the others, as the next smallest priorities are theirs. Only ranks up to
    sample_size that are floors or have a finite priority go into the order, so it never holds more than sample_size
    rows of a category; ties are broken by category and unit.
    """
    x = queue.filter("rank <= sample_size and (floor or priority < double('infinity'))")
    return ranked_by_priority(x).filter("seat <= sample_size")


def proportional_sample(pool: DataFrame, unit: str, fields: list[str], targets: DataFrame, seed: int = 7) -> DataFrame:
    """(category_field, category, unit, rank, priority, floor) of every drawn unit, per field of ``targets``.

    ``targets`` has category_field, category, target_share, min_rows and sample_size. A unit with records of several
    categories can be drawn in each, as it counts in each. Repeated records of a unit count once; an empty pool gives
    an empty sample. See ``queues`` and ``drawn``.
    """
    return drawn(queues(pool, unit, fields, targets, seed)).select("category_field", "category", "unit", "rank", "priority", "floor")


def ranked_by_priority(x: DataFrame, buckets: int = 512) -> DataFrame:
    """``x`` with its ``seat``: the place in its field by (not floor, priority, c, unit), numbered bucket by bucket.

    Priorities are cut into ranges of equal width between 0 and the field's largest, floors first; a window over the
    sizes of the ranges gives their offsets, so no field is sorted in one task.
    """
    top = x.groupBy("category_field").agg(F.max(F.when(~F.col("floor"), F.col("priority"))).alias("top"))
    y = x.join(bounded_broadcast(cut(top)), "category_field")
    y = y.withColumn("b", F.when(F.col("floor"), -1).otherwise(F.least(F.lit(buckets - 1), F.floor(F.col("priority") / F.col("top") * buckets))).cast("int"))
    sizes = y.groupBy("category_field", "b").agg(F.count("*").alias("k"))
    offsets = sizes.select("category_field", "b", F.coalesce(F.sum("k").over(Window.partitionBy("category_field").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    inside = Window.partitionBy("category_field", "b").orderBy("priority", "c", "unit")
    y = y.withColumn("i", F.row_number().over(inside)).join(offsets, ["category_field", "b"])
    return y.withColumn("seat", F.col("i") + F.col("o")).drop("b", "i", "o", "top")


def shortages(queue: DataFrame, targets: DataFrame) -> DataFrame:
    """Every target with quota, required (the greater of quota and min_rows), available, and whether it is short.

    A category is short where its queue ends before it reaches the priority of the required unit, or before its floor
    is full where the share is 0. ``available`` is the queue's last rank.
    """
    ends = queue.groupBy("category_field", "c").agg(F.max("priority").alias("last"), F.max("rank").alias("available"), F.count_if("floor").alias("floors"))
    x = _required(targets).join(bounded_broadcast(cut(ends)), ["category_field", "c"], "left").na.fill(0, ["available", "floors"])
    by_floor = F.col("floors") < F.col("required")
    short = F.when(F.col("required") <= 0, False).when(F.col("target_share") > 0, F.coalesce(F.col("last") < _priority(F.col("required")), F.lit(True))).otherwise(by_floor)
    return x.select("category_field", "category", "target_share", "quota", "required", "available", short.alias("short"))


def sample_report(pool: DataFrame, unit: str, fields: list[str], targets: DataFrame, seed: int = 7) -> DataFrame:
    """``shortages`` with the number of units ``drawn``, both from the same ranked and floored table."""
    queue = queues(pool, unit, fields, targets, seed)
    got = drawn(queue).groupBy("category_field", "category").agg(F.count("*").alias("drawn"))
    x = shortages(queue, targets).join(bounded_broadcast(cut(got)), ["category_field", "category"], "left").na.fill(0, ["drawn"])
    return x.select("category_field", "category", "target_share", "quota", "required", "available", "drawn", "short")


def fitted(available: np.ndarray, margins: list[np.ndarray], rounds: int = 100) -> np.ndarray:
    """Real-valued seats of every cell: the available numbers scaled in turn to each margin, never above themselves.

    Where the margins can't be met with what is available the last scaling wins and the caps stay.
    """
    x = available.astype(float)
    for _ in range(rounds):
        for axis, want in enumerate(margins):
            others = tuple(i for i in range(x.ndim) if i != axis)
            have = x.sum(axis=others)
            factor = np.divide(want, have, out=np.zeros_like(want, dtype=float), where=have > 0)
            x = np.minimum(x * factor.reshape([-1 if i == axis else 1 for i in range(x.ndim)]), available)
    return x


def joint_sample(pool: DataFrame, unit: str, record: str, fields: list[str], targets: DataFrame, seed: int = 7) -> DataFrame:
    """(record, unit, fields, priority, floor): one sample whose shares meet the targets of all fields together.

    Each unit is represented by its smallest ``record``. The categories of the fields (and one for all without a
    target, which gets no seats) form cells, at most the product of the numbers of targets plus one; their sizes are
    scaled to the margins of all fields (``fitted``), and the divisor method runs over the cells: the unit of rank r
    in a cell with x seats has the priority (r - 0.5) / x. The first min_rows units of every category, in random
    order, come before all others; then the smallest priorities fill the sample. Null units are not drawn.
    """
    t = cut(_required(targets))
    known = {f: [] for f in fields}
    share: dict[tuple[str, str], tuple[float, int]] = {}
    size = 0
    for r in t.collect():
        if r["category_field"] in known:
            known[r["category_field"]].append(r["c"])
            share[r["category_field"], r["c"]] = (float(r["target_share"] or 0), int(r["min_rows"] or 0))
            size = max(size, int(r["sample_size"] or 0))
    for f in fields:
        known[f].sort()
    at = [F.coalesce(F.when(label(f).isin(known[f]), label(f)), F.lit("")).alias(f"c{i}") for i, f in enumerate(fields)]
    cells = [f"c{i}" for i in range(len(fields))]
    one = pool.filter(F.col(unit).isNotNull()).select(F.col(unit).alias("unit"), F.struct(F.col(record).cast("string").alias("record"), *at).alias("r"))
    units = cut(one.groupBy("unit").agg(F.min("r").alias("r")).select("unit", "r.*"))
    shape = [len(known[f]) + 1 for f in fields]
    available = np.zeros(shape)
    for r in units.groupBy(*cells).agg(F.count("*").alias("n")).collect():
        available[tuple(known[f].index(r[c]) + 1 if r[c] else 0 for f, c in zip(fields, cells))] = r["n"]
    margins = [np.array([0.0, *[share[f, c][0] * size for c in known[f]]]) for f in fields]
    seats = fitted(available, margins)
    spark = pool.sparkSession
    listed = [(*[known[f][k - 1] if k else "" for f, k in zip(fields, i)], float(seats[i])) for i in np.ndindex(*shape) if available[i]]
    table = spark.createDataFrame(listed, ", ".join(f"{c} string" for c in cells) + ", seats double")
    x = ranked(units, cells, F.xxhash64("unit", F.lit(seed))).join(bounded_broadcast(table), cells)
    for i, f in enumerate(fields):
        x = ranked(x, [f"c{i}"], F.xxhash64("unit", F.lit(seed + 1 + i)), name=f"r{i}")
        floors = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for c in known[f] for v in (c, share[f, c][1])] or [F.lit(""), F.lit(0)]), F.col(f"c{i}")), F.lit(0))
        x = x.withColumn(f"f{i}", F.col(f"r{i}") <= floors)
    floor = F.lit(False)
    for i in range(len(fields)):
        floor = floor | F.col(f"f{i}")
    x = x.withColumn("floor", floor).withColumn("priority", F.when(F.col("seats") > 0, (F.col("rank") - 0.5) / F.col("seats")).otherwise(F.lit(float("inf"))))
    x = cut(x.filter("floor or priority < double('infinity')").withColumn("category_field", F.lit("all")).withColumn("c", F.concat_ws("|", *cells)))
    drawn = ranked_by_priority(x).filter(F.col("seat") <= size)
    return drawn.select("record", "unit", *[F.col(c).alias(f) for c, f in zip(cells, fields)], "priority", "floor")
