"""Joins and ranks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot if it holds more than this share of the rows; at most 1 / HOT_SHARE keys can.
HOT_SHARE = 0.001
#: Keys with fewer rows than this never hurt, whatever their share.
HOT_ROWS = 20_000
#: Rows that may be broadcast: the tables in question have a few short columns each.
BROADCAST_ROWS = 50_000


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, without one beyond.

    The size is checked by reading at most ``most`` + 1 rows. Without the hint the join is a shuffle join.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its scan has fewer partitions than there are cores (one large file, say).

    For steps that spend much time on a row; a scan with enough partitions is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def join_keyed(big: DataFrame, keyed: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of ``big`` with ``keyed``, which has one row per key and the key's row count in ``big`` as ``rows``.

    Keys with more than HOT_SHARE of all rows go through a broadcast of at most 1 / HOT_SHARE rows (no more keys can
    have so large a share), all others through a shuffle, in which no key can hold more than that share. ``rows`` is
    dropped. ``big`` and ``keyed`` should be cut tables, since they are read twice where hot keys exist. A null key
    joins nothing; an empty side gives an empty result.
    """
    total, most = keyed.agg(F.coalesce(F.sum(rows), F.lit(0)), F.coalesce(F.max(rows), F.lit(0))).first()
    least = max(HOT_ROWS, total * HOT_SHARE)
    hot = [r[0] for r in keyed.filter(F.col(rows) > least).select(key).collect()] if most > least else []
    plain = keyed.drop(rows)
    if not hot:
        return big.join(plain, key)
    is_hot = F.col(key).isin(hot)
    return big.filter(is_hot).join(F.broadcast(plain.filter(is_hot)), key).unionByName(
        big.filter(~is_hot).join(plain.filter(~is_hot), key)
    )


#: Rows of one side that one key brings into one task of ``product_join``.
BLOCK = 4_000


def product_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join whose result holds every pair of a left and a right row of a key, with no key in one task.

    Keys of both sides are counted first; the left rows of a key with more than BLOCK of them are dealt into blocks
    by a hash, the right rows are repeated once a block, and pairs of (key, block) are joined. A key with few left
    rows has one block, so nothing is repeated for it. Null keys join nothing. Both sides should be cut tables.
    """
    a = left.groupBy(*on).agg(F.count("*").alias("__l"))
    b = right.select(*on).distinct()
    size = F.ceil(F.col("__l") / BLOCK).cast("int")
    hot = bounded_broadcast(a.join(b, on, "left_semi").filter(F.col("__l") > BLOCK).select(*on, size.alias("__k")))
    blocks = F.coalesce("__k", F.lit(1))
    x = left.join(hot, on, "left").withColumn("__b", F.pmod(F.xxhash64(*[c for c in left.columns if c not in on]), blocks)).drop("__k")
    y = right.join(hot, on, "left").withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), (blocks - 1).cast("bigint")))).drop("__k")
    return x.join(y, [*on, "__b"]).drop("__b")


def ranked(df: DataFrame, group: list[str], order: Column, name: str = "rank", buckets: int = 256) -> DataFrame:
    """Number the rows of each group from 1 in the order of the 64-bit hash ``order``, without one task per group.

    The hash range is cut into ``buckets`` ranges; a window over the small table of bucket sizes gives every bucket
    its offset and a second window numbers the rows inside (group, bucket), so a group with a third of all rows is
    spread over ``buckets`` tasks. Rows with equal hashes are told apart by their other columns, then are the same
    row. Null group values form a group. An empty table stays empty.
    """
    ties = [F.col(c).cast("string") for c, kind in df.dtypes if not kind.startswith("map")]
    x = df.withColumn("__h", order).withColumn("__b", (F.shiftrightunsigned("__h", 48) * buckets / 65536).cast("int"))
    keys = [F.col(c) for c in group]
    sizes = x.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__h", *ties)
    x = x.withColumn("__i", F.row_number().over(inside))
    on = [x["__b"].eqNullSafe(offsets["__b"])] + [x[c].eqNullSafe(offsets[c]) for c in group]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = x.join(offsets.select(*[F.col(c).alias(c) for c in group], "__b", "__o"), cond)
    return out.select(*[x[c] for c in df.columns], (F.col("__i") + F.col("__o")).cast("bigint").alias(name))
