"""Splitting and sampling: group-aware stratified splits, per-class heads, systematic and seeded samples.

Choices follow a seeded digest of the key, not a generator, so they depend on the key and the seed alone: neither row
order nor partitioning changes them, and any engine that has the digest gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mullion.scale import Scratch, numbered


def seeded(seed: int, key: Column) -> Column:
    """A repeatable order of keys for a seed."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def grouped_split(rows: DataFrame, label: str, group: str, path: str, fraction: float, seed: int, scratch: Scratch, least: int = 3) -> DataFrame:
    """Adds `side` (train or val): whole groups, stratified by class, about `fraction` of each class's groups in val.

    A row without a group is a group by its path. A group has the class of its smallest path. A class with fewer than
    `least` groups stays in train; otherwise at least one group and not all go to val; shares round half to even.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    keyed = rows.withColumn("_g", F.coalesce(F.concat(F.lit("g|"), F.nullif(F.trim(F.col(group)), F.lit(""))), F.concat(F.lit("p|"), F.coalesce(F.col(path), F.lit("")))))
    groups = keyed.groupBy("_g").agg(F.min_by(label, path).alias("_c")).withColumn("_o", seeded(seed, F.col("_g")))
    order = numbered(groups, ["_c"], ["_o", "_g"], scratch, "_rank")
    sizes = groups.groupBy("_c").agg(F.count(F.lit(1)).alias("_k")).select(F.col("_c").alias("_d"), "_k")
    wanted = F.greatest(F.lit(1), F.least(F.bround(F.col("_k") * F.lit(fraction)).cast("long"), F.col("_k") - 1))
    chosen = order.join(sizes, F.col("_c").eqNullSafe(F.col("_d"))).where((F.col("_k") >= least) & (F.col("_rank") <= wanted)).select("_g", F.lit("val").alias("side"))
    return keyed.join(chosen, "_g", "left").select(*rows.columns, F.coalesce("side", F.lit("train")).alias("side"))


def head_per_class(rows: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """The first n rows of each class by a column; a top-n per key, of which each task keeps n rows before the sort."""
    w = Window.partitionBy(label).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cap_per_class(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """Up to n rows of each class in seeded order."""
    w = Window.partitionBy(label).orderBy(seeded(seed, F.col(key).cast("string")), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def every_kth(rows: DataFrame, order: str, k: int, scratch: Scratch) -> DataFrame:
    """Rows number 1, 1 + k, 1 + 2k ... in the order of a unique column."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return numbered(rows, [], [order], scratch, "_n").where((F.col("_n") - 1) % k == 0).drop("_n")


def probe(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, in seeded order."""
    return rows.orderBy(seeded(seed, F.col(key).cast("string")), key).limit(n)


def share_split(rows: DataFrame, group: str, shares: dict[str, int], seed: int) -> DataFrame:
    """Adds `side` by a hash bucket of 100 of the group, so that groups stay whole; no shuffle at all.

    shares are whole percents that sum to 100. Null groups fall into one bucket together.
    """
    if sum(shares.values()) != 100:
        raise ValueError("shares must sum to 100")
    bucket = F.conv(F.substring(seeded(seed, F.coalesce(F.col(group).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % 100
    side, upto = F.lit(None).cast("string"), 100
    for name, share in reversed(list(shares.items())):
        side = F.when(bucket < upto, name).otherwise(side)
        upto -= share
    return rows.withColumn("side", side)
