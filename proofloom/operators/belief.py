"""Belief of statements from the reliability of their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (random, systematic) error of each source.
PRIORS = {
    "reach": (0.30, 0.05),
    "sparser": (0.30, 0.05),
    "trips": (0.30, 0.05),
    "rlimsp": (0.20, 0.05),
    "medscan": (0.30, 0.05),
    "eidos": (0.30, 0.05),
    "cwms": (0.30, 0.05),
    "signor": (0.049, 0.01),
    "biogrid": (0.01, 0.01),
    "phosphosite": (0.01, 0.01),
    "cbn": (0.01, 0.01),
    "trrust": (0.10, 0.01),
    "tas": (0.01, 0.01),
    "hprd": (0.01, 0.01),
    "pid": (0.01, 0.01),
    "reactome": (0.01, 0.01),
    "kegg": (0.01, 0.01),
    "drugbank": (0.01, 0.01),
}
# The same as measured on curated records, for the sources that had enough of them.
RECALIBRATED = PRIORS | {
    "reach": (0.462, 0.05),
    "sparser": (0.516, 0.05),
    "trips": (0.077, 0.05),
    "medscan": (0.481, 0.05),
    "rlimsp": (0.056, 0.05),
}
# The same for any other source.
OTHER = (0.30, 0.10)


def prior_table(spark: SparkSession, priors: dict[str, tuple[float, float]] = PRIORS) -> DataFrame:
    """(source, rand, syst): a table as small as the dictionary."""
    return spark.createDataFrame([(s, r, y) for s, (r, y) in sorted(priors.items())], "source string, rand double, syst double")


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def noisy_or(score: Column) -> Column:
    """Aggregate: one minus the product of the clamped complements; null scores are left out, none at all gives null."""
    return F.lit(1.0) - F.product(F.when(score.isNotNull(), clamp(1 - score)))


def reliability(counts: DataFrame, keys: list[str], priors: dict[str, tuple[float, float]] = PRIORS) -> DataFrame:
    """(keys, reliability) from rows (keys, source, n): 1 - product over sources of (syst + rand ** n), clamped.

    Sources are looked up in lower case but not merged; counts of null or at most 0 are left out, and a key with none
    has reliability 0. The priors are a table of a few rows and are broadcast.
    """
    p = F.broadcast(prior_table(counts.sparkSession, priors))
    x = counts.withColumn("__s", F.lower("source")).join(p.withColumnRenamed("source", "__s"), "__s", "left")
    factor = F.coalesce("syst", F.lit(OTHER[1])) + F.pow(F.coalesce("rand", F.lit(OTHER[0])), "n")
    return x.groupBy(*keys).agg(F.product(F.when(F.col("n") > 0, factor)).alias("__p")).select(*keys, F.coalesce(clamp(1 - F.col("__p")), F.lit(0.0)).alias("reliability"))


def spread(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, n) from rows (keys, sources, total): one evidence a distinct source, the rest to the first by name."""
    x = edges.withColumn("__u", F.array_sort(F.array_distinct("sources"))).filter("total > 0")
    x = x.select(*keys, "total", F.size("__u").alias("__k"), F.posexplode("__u").alias("__i", "source"))
    return x.select(*keys, "source", F.when(F.col("__i") == 0, F.greatest(F.lit(1), 1 + F.col("total") - F.col("__k"))).otherwise(1).alias("n"))


def gated(evidence: DataFrame, keys: list[str], priors: dict[str, tuple[float, float]] = PRIORS) -> DataFrame:
    """(keys, belief, parametric, n_total, n_surviving, per_source) from rows (keys, source, included).

    Evidence is grouped by its source in lower case; a source none of whose evidence is included drops out. A null
    ``included`` counts as included, a null source raises an error when the row is read. ``per_source`` lists the
    sources by name with their numbers and what each leaves of the doubt; it costs nothing where it isn't selected.
    """
    src = F.coalesce(F.lower("source"), F.raise_error(F.lit("evidence without a source")))
    per = evidence.withColumn("__s", src).groupBy(*keys, "__s").agg(F.count("*").alias("__n"), F.count_if(F.coalesce("included", F.lit(True))).alias("__ok"))
    x = per.join(F.broadcast(prior_table(evidence.sparkSession, priors).withColumnRenamed("source", "__s")), "__s", "left")
    rand, syst = F.coalesce("rand", F.lit(OTHER[0])), F.coalesce("syst", F.lit(OTHER[1]))
    kept = F.product(F.when(F.col("__ok") == 0, 1.0).otherwise(syst + F.pow(rand, "__ok")))
    whole = F.product(syst + F.pow(rand, "__n"))
    return x.groupBy(*keys).agg(clamp(1 - kept).alias("belief"), clamp(1 - whole).alias("parametric"), F.sum("__n").alias("n_total"), F.sum("__ok").alias("n_surviving"), F.array_sort(F.collect_list(F.struct(F.col("__s").alias("source"), F.col("__n").alias("n"), F.col("__ok").alias("surviving"), F.when(F.col("__ok") > 0, syst + F.pow(rand, "__ok")).alias("doubt")))).alias("per_source"))


def contradiction(directed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reliability, direction, contradictory) from rows (keys, direction, reliability).

    The most reliable direction dominates (of equals the smaller name); it is weakened by the best of the other
    directions, of which unknown doesn't count. There are few directions, so a key's are gathered in one array.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("reliability")).alias("r"), "direction")))
    x = directed.groupBy(*keys).agg(ordered.alias("__d"))
    top = F.col("__d")[0]
    other = F.filter(F.slice("__d", 2, F.greatest(F.lit(1), F.size("__d"))), lambda d: d["direction"] != "unknown")
    best = F.get(other, F.lit(0))["r"]
    return x.select(*keys, (-top["r"] * (1 + F.coalesce(best, F.lit(0.0)))).alias("reliability"), top["direction"].alias("direction"), best.isNotNull().alias("contradictory"))


def gated_with_contradiction(evidence: DataFrame, keys: list[str], priors: dict[str, tuple[float, float]] = PRIORS) -> DataFrame:
    """(keys, belief, parametric, n_total, n_surviving, per_source, direction, contradictory) from rows (keys, source,
    included, direction).

    Every direction is gated by itself; a null direction is unknown. The direction with the greatest belief (of equals
    to twelve places the smaller name) gives parametric and per_source, its belief is weakened by the best belief of
    the other directions, of which unknown doesn't count. Numbers are summed over all directions.
    """
    d = evidence.withColumn("direction", F.coalesce("direction", F.lit("unknown")))
    each = gated(d, [*keys, "direction"], priors)
    order = F.array_sort(F.collect_list(F.struct((-F.round("belief", 12)).alias("r"), "direction", "belief", "parametric", "per_source")))
    x = each.groupBy(*keys).agg(order.alias("__d"), F.sum("n_total").alias("n_total"), F.sum("n_surviving").alias("n_surviving"))
    top = F.col("__d")[0]
    others = F.filter(F.slice("__d", 2, F.greatest(F.lit(1), F.size("__d"))), lambda y: y["direction"] != "unknown")
    best = F.array_max(F.transform(others, lambda y: y["belief"]))
    weakened = top["belief"] * (1 - F.coalesce(best, F.lit(0.0)))
    return x.select(*keys, weakened.alias("belief"), top["parametric"].alias("parametric"), "n_total", "n_surviving", top["per_source"].alias("per_source"), top["direction"].alias("direction"), best.isNotNull().alias("contradictory"))


def composed(scored: DataFrame, keys: list[str], priors: dict[str, tuple[float, float]] = PRIORS, gate_unscored: bool = False, directions: bool = False) -> DataFrame:
    """Belief of edges or statements from their scored evidence: rows (keys, source, verdict), and direction if asked for.

    An evidence is included if its verdict passes the gate (``passes``); the rest is ``gated`` or, with ``directions``,
    ``gated_with_contradiction``. Adds n_gated and has_scores, whether any evidence has a verdict. A null source counts
    as unknown.
    """
    rows = scored.withColumn("source", F.coalesce("source", F.lit("unknown"))).withColumn("included", passes(F.col("verdict"), gate_unscored))
    result = (gated_with_contradiction if directions else gated)(rows, keys, priors)
    has = scored.groupBy(*keys).agg(F.max(F.col("verdict").isNotNull()).alias("has_scores"))
    return result.withColumn("n_gated", F.col("n_total") - F.col("n_surviving")).join(has, keys)


def passes(verdict: Column, gate_unscored: bool = False) -> Column:
    """Whether an evidence counts: correct does, incorrect doesn't; abstain and none do unless ``gate_unscored``."""
    v = F.lower(verdict)
    return F.when(v.isNull() | (v == "abstain"), F.lit(not gate_unscored)).otherwise(v == "correct")
