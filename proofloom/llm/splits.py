"""Splits that keep related records together, by a min-cost flow over bundles of equal components.

Components of equal size and equal label profile (the number of records of every label) form a bundle. All arcs from
bundles are free and uncapped, so the flow depends on the labels' totals alone: it is solved from labels to splits and
gives every label's quota in every split. A bundle's share of a split follows from its profile and these quotas. The
shares are rounded to whole components per size, largest first, and dealt to the bundles of a size in turn, so each
bundle gets its proportion to within a component; its members are told apart by a hash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.lineage import cut
from proofloom.operators.components import connected
from proofloom.operators.skew import bounded_broadcast, join_keyed, ranked

#: Labels are categories: more of them than this raise an error, as their totals come to the driver.
MOST_LABELS = 100_000
#: Cost of a record beyond its label's quota in a split, and of one beyond the split's quota.
LABEL_COST, SPLIT_COST = 1, 1_000


def digits(c: Column | str) -> Column:
    """The digits of a value; null without any."""
    x = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\D+", "")
    return F.when(x != "", x)


def number(c: Column | str) -> Column:
    """A value as a whole number's text, without blanks, plus sign or leading zeros; null without digits."""
    x = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", "")
    body = F.regexp_replace(digits(x), r"^0+(?=\d)", "")
    return F.when(x.rlike(r"^[-−]") & (body != "0"), F.concat(F.lit("-"), body)).otherwise(body)


def related(rows: DataFrame) -> DataFrame:
    """(id, first): every record of ``rows`` (id, keys: an array of texts) with the smallest id of its component.

    Records with a key in common, directly or through others, are one component. Every key links its records to its
    smallest record, so a key that a third of all rows share gives one link a row and no pairs. A record without keys
    is its own component; null keys link nothing; a null id is left out; repeated rows count once.
    """
    x = cut(rows.filter("id is not null").select("id", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key")))
    least = cut(x.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    links = join_keyed(x, least, "key", "n").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    roots = connected(links)
    return rows.filter("id is not null").select("id").distinct().join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("first"))


class Flow:
    """Min-cost flow by successive cheapest paths with potentials."""

    def __init__(self) -> None:
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, most: int, cost: int) -> int:
        for x, y, m, c in ((a, b, most, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(m)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        n = len(self.out)
        high = [0] * n
        while True:
            dist: list[float] = [float("inf")] * n
            by = [-1] * n
            dist[s], heap = 0, [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    if self.left[e] and (w := d + self.cost[e] + high[a] - high[b]) < dist[b]:
                        dist[b], by[b] = w, e
                        heapq.heappush(heap, (w, b))
            if by[t] < 0:
                return
            high = [h + (d if d < float("inf") else 0) for h, d in zip(high, dist)]
            path, at = [], t
            while at != s:
                path.append(by[at])
                at = self.to[by[at] ^ 1]
            push = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= push
                self.left[e ^ 1] += push


def quotas(totals: dict[str, int], shares: dict[str, float]) -> dict[str, dict[str, int]]:
    """Records of each label per split: a min-cost flow from the labels' totals to the splits' quotas.

    Within the label's share of a split a record costs nothing, beyond it LABEL_COST, beyond the split's own quota
    SPLIT_COST. The whole part of every share is free and flows at once; what is left of a label is less than one
    record a split. Labels whose rest looks the same are one node, so the flow does not grow with the labels.
    """
    names = sorted(shares)
    whole = sum(shares.values()) or 1.0
    part = {x: shares[x] / whole for x in names}
    out = {k: {x: int(n * part[x] + 1e-9) for x in names} for k, n in totals.items()}
    alike: dict[tuple, list[str]] = {}
    for k, n in sorted(totals.items()):
        rest = n - sum(out[k].values())
        if rest:
            alike.setdefault((rest, tuple(round(n * part[x]) - out[k][x] for x in names)), []).append(k)
    f = Flow()
    source, sink = f.node(), f.node()
    total = sum(totals.values())
    split = {x: f.node() for x in names}
    for x in names:
        f.arc(split[x], sink, max(0, round(part[x] * total) - sum(q[x] for q in out.values())), 0)
        f.arc(split[x], sink, total, SPLIT_COST)
    arcs = {}
    for (rest, room), labels in sorted(alike.items()):
        node = f.node()
        f.arc(source, node, rest * len(labels), 0)
        for x, r in zip(names, room):
            free, dear = max(0, r) * len(labels), rest * len(labels)
            arcs[rest, room, x] = f.arc(node, split[x], free, 0), f.arc(node, split[x], dear, LABEL_COST)
    f.run(source, sink)
    for (rest, room), labels in alike.items():
        given = [x for x in names for _ in range(sum(f.left[e ^ 1] for e in arcs[rest, room, x]))]
        for i, x in enumerate(given):
            out[labels[i % len(labels)]][x] += 1
    return out


def rounded(sizes: list[tuple[int, int, dict[str, float]]]) -> list[dict[str, int]]:
    """Whole components per split for entries (size, components, records wanted per split), the largest size first.

    An entry takes the whole part of what it wants and of what larger ones left over or overdrew in a split; its
    remaining components go to the splits that lack most, and the rest is carried on.
    """
    out = []
    carry: dict[str, float] = {}
    for s, c, wanted in sizes:
        want = {x: round(w + carry.get(x, 0), 6) for x, w in wanted.items()}
        mine = {x: int(max(0, want[x]) // s) for x in want}
        while (spare := c - sum(mine.values())) != 0:
            x = (max if spare > 0 else min)((y for y in want if spare > 0 or mine[y]), key=lambda y: (want[y] - mine[y] * s, y))
            mine[x] += 1 if spare > 0 else -1
        out.append(mine)
        carry = {x: want[x] - mine[x] * s for x in want}
    return out


def allocate(bundles: list[tuple[int, str, int]], shares: dict[str, float]) -> dict[tuple[int, str], dict[str, int]]:
    """Components of each bundle (size, label, count) per split, for bundles of one label each that the driver holds."""
    totals: dict[str, int] = {}
    for s, label, c in bundles:
        totals[label] = totals.get(label, 0) + s * c
    q = quotas(totals, shares)
    order = sorted(bundles, reverse=True)
    plan = rounded([(s, c, {x: q[label][x] * s * c / totals[label] for x in sorted(shares)}) for s, label, c in order])
    return {(s, label): mine for (s, label, _), mine in zip(order, plan)}


def _bundle_offsets(groups: DataFrame, buckets: int = 256) -> DataFrame:
    """(size, profile, before): the number of components in the bundles of a size before each bundle, bucket by bucket."""
    b = groups.groupBy("size", "profile").agg(F.count("*").alias("n")).withColumn("part", F.pmod("profile", F.lit(buckets)))
    parts = b.groupBy("size", "part").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("size", "part", F.coalesce(F.sum("n").over(before("size").orderBy("part")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(before("size", "part").orderBy("profile")), F.lit(0))
    return b.withColumn("inside", inside).join(starts, ["size", "part"]).select("size", "profile", (F.col("start") + F.col("inside")).alias("before"))


def dealt(position: Column, plan: Column) -> Column:
    """The split of the component at a ``position`` (from 1) of its size; ``plan`` is an array of (split, k).

    The k components of a split are spread evenly over the positions, those of the next evenly over what remains.
    """
    total = F.aggregate(plan, F.lit(0).cast("bigint"), lambda s, p: s + p["k"])
    kind = "struct<i:bigint,c:bigint,split:string>"

    def step(s: Column, p: Column) -> Column:
        up_to = F.floor(s["i"] * p["k"] / s["c"])
        mine = (p["k"] > 0) & (up_to > F.floor((s["i"] - 1) * p["k"] / s["c"]))
        went_on = F.struct((s["i"] - up_to).alias("i"), (s["c"] - p["k"]).alias("c"), F.when(mine, p["split"]).alias("split"))
        return F.when(s["split"].isNotNull(), s).otherwise(went_on.cast(kind))

    first = F.struct(position.cast("bigint").alias("i"), total.alias("c"), F.lit(None).cast("string").alias("split")).cast(kind)
    return F.aggregate(plan, first, step)["split"]


def grouped_splits(rows: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(id, first, split) for records ``rows`` (id, keys, label) and the proportions ``targets`` (split, target_share).

    The driver holds the labels' totals (labels are categories; more than MOST_LABELS raise a ValueError) and, per
    distinct component size, the records wanted of every split; there are fewer sizes than the square root of twice
    the number of records. Bundles and components stay distributed. Records without keys are components of one. A
    null label is a label; an empty pool gives an empty result; shares need not add up to 1; no targets raise a
    ValueError.
    """
    shares = {r["split"]: float(r["target_share"]) for r in targets.collect()}
    if not shares:
        raise ValueError("no target shares")
    spark = rows.sparkSession
    members = cut(related(rows.select("id", "keys")))
    labels = rows.filter("id is not null").groupBy("id").agg(F.min(F.coalesce("label", F.lit(""))).alias("label"))
    counts = cut(members.join(labels, "id").groupBy("first", "label").agg(F.count("*").alias("n")))
    totals = {r[0]: r[1] for r in counts.groupBy("label").agg(F.sum("n")).limit(MOST_LABELS + 1).collect()}
    if len(totals) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    q = quotas(totals, shares)
    rates = spark.createDataFrame([(k, [v[x] / totals[k] for x in sorted(shares)]) for k, v in q.items()], "label string, rates array<double>")
    weighed = counts.join(bounded_broadcast(rates), "label")
    sums = [F.sum(F.col("n") * F.col("rates")[i]).alias(f"w{i}") for i in range(len(shares))]
    profile = F.xxhash64(F.array_sort(F.collect_list(F.struct("label", "n"))))
    groups = cut(weighed.groupBy("first").agg(F.sum("n").alias("size"), profile.alias("profile"), *sums))
    sizes = groups.groupBy("size").agg(F.count("*").alias("c"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(shares))]).collect()
    sizes.sort(key=lambda r: -r["size"])
    plan = rounded([(r["size"], r["c"], {x: r[f"w{i}"] for i, x in enumerate(sorted(shares))}) for r in sizes])
    listed = [(r["size"], [(x, mine[x]) for x in sorted(mine, key=lambda x: (-mine[x], x))]) for r, mine in zip(sizes, plan)]
    table = spark.createDataFrame(listed, "size bigint, plan array<struct<split:string,k:bigint>>")
    numbered = ranked(groups.select("first", "size", "profile"), ["size", "profile"], F.xxhash64("first", F.lit(seed)))
    placed = numbered.join(_bundle_offsets(groups), ["size", "profile"]).join(bounded_broadcast(table), "size")
    chosen = placed.select("first", dealt(F.col("before") + F.col("rank"), F.col("plan")).alias("split"))
    return members.join(chosen, "first").select("id", "first", "split")
