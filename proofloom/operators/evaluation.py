"""Offline evaluation: calibration error, ranking quality, significance, samples and contamination."""

from __future__ import annotations

from collections import Counter
from math import comb, exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.operators.skew import bounded_broadcast


#: Discordant pairs up to which the tail is summed in whole numbers; beyond it in logarithms, in time of their root.
EXACT_PAIRS = 1_000


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p of b and c discordant pairs: twice the upper tail of Binomial(b + c, 1/2), 1 at most."""
    n, k = b + c, max(b, c)
    if n <= EXACT_PAIRS:
        return min(1.0, 2 * sum(comb(n, i) for i in range(k, n + 1)) / 2**n) if n else 1.0
    term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2))
    tail = 0.0
    while k <= n and term > tail * 1e-18:  # terms fall from the middle on, so the tail ends early
        tail, term, k = tail + term, term * (n - k) / (k + 1), k + 1
    return min(1.0, 2 * tail)


def discordance(x: DataFrame, a: Column, b: Column, keys: list[str] | None = None) -> DataFrame:
    """Both right, a only, b only, both wrong, for two boolean columns; rows with a null are left out."""
    y = x.withColumns({"__a": a, "__b": b}).filter("__a is not null and __b is not null")
    return y.groupBy(*(keys or [])).agg(F.count_if(F.expr("__a and __b")).alias("both"), F.count_if(F.expr("__a and not __b")).alias("a_only"), F.count_if(F.expr("__b and not __a")).alias("b_only"), F.count_if(F.expr("not __a and not __b")).alias("neither"))


def reliability_bins(x: DataFrame, score: Column, truth: Column, edges: list[float]) -> DataFrame:
    """(bin, n, confidence, accuracy, gap) over half-open bins [edge, next edge); scores outside and nulls are left out."""
    s = x.select(score.alias("s"), truth.cast("double").alias("t")).filter("s is not null and t is not null")
    index = sum((F.when(F.col("s") >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    y = s.withColumn("bin", index).filter((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    y = y.groupBy("bin").agg(F.count("*").alias("n"), F.avg("s").alias("confidence"), F.avg("t").alias("accuracy"))
    return y.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def ece(bins: DataFrame, total: Column | None = None) -> DataFrame:
    """Expected calibration error: the gaps weighted by bin size."""
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / (total if total is not None else F.sum("n"))).alias("ece"), F.sum("n").alias("n"))


def brier(x: DataFrame, score: Column, truth: Column, keys: list[str] | None = None) -> DataFrame:
    """Mean squared difference of score and truth."""
    return x.groupBy(*(keys or [])).agg(F.avg(F.pow(score - truth.cast("double"), 2)).alias("brier"))


def average_precision(x: DataFrame, score: Column, truth: Column) -> DataFrame:
    """Area under the precision-recall curve as the sum of precision times recall gain, equal scores taken together.

    The cumulative counts run over one row per distinct score; distinct scores are bucketed by rounding only by the
    caller. Null scores and truths are left out; without positives the result is null.
    """
    s = x.select(score.alias("s"), truth.cast("int").alias("t")).filter("s is not null and t is not null")
    g = s.groupBy("s").agg(F.sum("t").alias("tp"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    c = g.select("tp", F.sum("tp").over(w).alias("ctp"), F.sum("n").over(w).alias("cn"))
    return c.agg((F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.sum("tp")).alias("auprc"))


def normalized(text: Column) -> Column:
    """White space collapsed, outer blanks and trailing punctuation dropped, lower case."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.lower(F.regexp_replace(x, r"""[.!?,;:"']+$""", ""))


def contamination(examples: DataFrame, evals: DataFrame, window: int = 50, step: int = 5) -> DataFrame:
    """(example_id, eval_id, kind) for examples and evals (id, text): exact, contained or shingle.

    exact: equal normalized texts. contained: one normalized text of at least 30 characters lies within the other.
    shingle: a ``window``-character piece of the example (every ``step`` characters) occurs in the other text. Equal
    texts are an equi join. For the others every example piece of ``window`` (30 for contained) characters is joined
    by its hash with all pieces of that length of the eval texts, so no pair is formed that shares no piece; the test
    itself is then exact. Null, empty and shorter texts have no row; a pair is reported under its strongest kind.
    """
    a = examples.select(F.col("id").alias("example_id"), normalized(F.col("text")).alias("x")).filter("x <> ''")
    b = evals.select(F.col("id").alias("eval_id"), normalized(F.col("text")).alias("y")).filter("y <> ''")
    exact = a.join(b, F.col("x") == F.col("y")).select("example_id", "eval_id", F.lit("exact").alias("kind"))

    def pieces(df: DataFrame, key: str, col: str, size: int, by: int) -> DataFrame:
        ok = df.filter(F.length(col) >= size)
        return ok.select(key, F.explode(F.expr(f"array_distinct(transform(sequence(1, length({col}) - {size - 1}, {by}), i -> xxhash64(substr({col}, i, {size}))))")).alias("h"))

    inside = []
    for short, key, col, other, okey, ocol in ((a, "example_id", "x", b, "eval_id", "y"), (b, "eval_id", "y", a, "example_id", "x")):
        heads = short.filter(F.length(col) >= 30).select(key, F.xxhash64(F.substring(col, 1, 30)).alias("h"))
        hit = heads.join(pieces(other, okey, ocol, 30, 1), "h").select("example_id", "eval_id").distinct()
        full = hit.join(a, "example_id").join(b, "eval_id").filter(F.col("x") != F.col("y")).filter(F.expr(f"contains({ocol}, {col})"))
        inside.append(full.select("example_id", "eval_id", F.lit("contained").alias("kind")))
    shared = pieces(a, "example_id", "x", window, step).join(pieces(b, "eval_id", "y", window, 1), "h").select("example_id", "eval_id", F.lit("shingle").alias("kind"))
    rank = F.min(F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "contained", 1).otherwise(2))
    every = exact.unionByName(inside[0]).unionByName(inside[1]).unionByName(shared)
    return every.groupBy("example_id", "eval_id").agg(F.element_at(F.array(*map(F.lit, ("exact", "contained", "shingle"))), rank + 1).alias("kind"))


def capped_sample(pool: DataFrame, cls: str, per_class: int, order: Column, exclude: DataFrame | None = None, key: str = "id") -> DataFrame:
    """``per_class`` rows of every class in the order given, without the keys of ``exclude``."""
    x = pool if exclude is None else pool.join(bounded_broadcast(exclude.select(key).distinct()), key, "left_anti")
    return x.withColumn("__r", F.row_number().over(Window.partitionBy(cls).orderBy(order, key))).filter(F.col("__r") <= per_class).drop("__r")


#: Least numbers by tag of a stratified sample: a share of its size, or a number of rows.
TAG_LEAST = {"correct": 0.40, "grounding": 0.10, "no_relation": 0.08, "wrong_relation": 0.06, "entity_boundaries": 0.05, "act_vs_amt": 0.05, "polarity": 0.04, "other": 0.04, "hypothesis": 0.02, "negative_result": 0.02, "mod_site": 5, "agent_conditions": 5}


def stratified_sample(pool: DataFrame, target: int, cap_share: float = 0.35, least: dict[str, float] = TAG_LEAST, seed: int = 42, cls: str = "cls", tag: str = "tag", key: str = "id") -> DataFrame:
    """``target`` rows of ``pool``, no class with more than ``cap_share`` of them, tags with their ``least`` numbers first.

    Tags are filled in the order given, a row of each class in turn; what remains of the target is filled from all
    other rows in seeded hash order. The cap holds in both passes, and a tag or pool that runs out gives what it has, so
    there may be fewer than ``target`` rows. A null class or tag is one of its own. ``key`` must be unique. The driver
    gets the row counts of classes within the tags of ``least``.
    """
    cap = int(target * cap_share)
    x = pool.withColumn("__c", F.coalesce(cls, F.lit("?"))).withColumn("__t", F.coalesce(tag, F.lit("?"))).withColumn("__h", F.xxhash64(F.lit(seed), key))
    cells = x.filter(F.col("__t").isin(*least)).groupBy("__t", "__c").agg(F.count("*").alias("n"), F.xxhash64(F.lit(seed), "__t", "__c").alias("h")).collect()
    by_tag = {t: [r for r in sorted(cells, key=lambda r: (r["h"], r["__c"])) if r["__t"] == t] for t in least}
    left, used, take, total = {(r["__t"], r["__c"]): r["n"] for r in cells}, Counter(), Counter(), 0
    for t, share in least.items():
        wanted, drew = int(target * share) if isinstance(share, float) else share, True
        got = 0
        while drew:
            drew = False
            for r in by_tag[t]:
                cell = (t, r["__c"])
                if got < wanted and total < target and take[cell] < left[cell] and used[r["__c"]] < cap:
                    take[cell], used[r["__c"]], got, total, drew = take[cell] + 1, used[r["__c"]] + 1, got + 1, total + 1, True
    spark = pool.sparkSession
    drawn = F.broadcast(spark.createDataFrame([(t, c, n) for (t, c), n in take.items()], "__t string, __c string, __take int"))
    room = F.broadcast(spark.createDataFrame(list(used.items()), "__c string, __used int"))
    order = [F.col("__h"), F.col(key)]
    most = cap + max(take.values(), default=0)  # of a cell no more rows than these can be used
    y = x.withColumn("__r", F.row_number().over(Window.partitionBy("__t", "__c").orderBy(*order))).filter(F.col("__r") <= most)
    y = y.join(drawn, ["__t", "__c"], "left").join(room, "__c", "left").na.fill(0, ["__take", "__used"])
    first = y.filter("__r <= __take")
    rest = y.filter("__r > __take").withColumn("__k", F.row_number().over(Window.partitionBy("__c").orderBy(*order)))
    rest = rest.filter(F.col("__k") <= F.lit(cap) - F.col("__used")).orderBy(*order).limit(target - total)
    return first.select(*pool.columns).unionByName(rest.select(*pool.columns))
