"""Profiles of record manifests: counts by split and class, medians, duplicate groups and their breakdown.

All aggregates combine before the shuffle. Nulls form groups of their own; empty tables give no groups, or one row of
zeros where a single row is the result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mullion.scale import Scratch, running_sums


def split_summary(manifest: DataFrame) -> DataFrame:
    """Per split: records, classes, the first and last class by name, corrupt records."""
    return manifest.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("class_label").alias("n_classes"),
        F.min("class_label").alias("first_class"),
        F.max("class_label").alias("last_class"),
        F.count_if(F.coalesce("is_corrupt", F.lit(False))).alias("n_corrupt"),
    )


def class_list(manifest: DataFrame) -> DataFrame:
    """Per split, the sorted class names as one text; classes are a bounded vocabulary, records are not."""
    return manifest.select("split", "class_label").distinct().groupBy("split").agg(F.array_join(F.array_sort(F.collect_list("class_label")), "|").alias("classes"))


def exact_medians(df: DataFrame, columns: Sequence[str], scratch: Scratch) -> DataFrame:
    """One row of exact medians of columns cast to numbers; what can't be cast is left out.

    Values are counted first and summed up over ranges in order; the middle is the least value that enough rows reach,
    so that no task holds all values of a column.
    """
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").try_cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")
    by = df.select(one).select("x.c", "x.v").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    run = running_sums(by, [F.col("c"), F.col("v")], {"upto": F.col("n")}, scratch)
    ends = run.groupBy(F.col("c").alias("e")).agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.max("upto").alias("stop"))
    placed = run.join(F.broadcast(ends), F.col("c") == F.col("e")).select("c", "v", (F.col("upto") - F.col("start")).alias("at"), (F.col("stop") - F.col("start")).alias("all"))
    lower, upper = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    middle = lambda i: (F.min(F.when((F.col("c") == i) & (F.col("at") >= lower), F.col("v"))) + F.min(F.when((F.col("c") == i) & (F.col("at") >= upper), F.col("v")))) / 2
    return placed.agg(*[middle(i).alias(f"median_{c}") for i, c in enumerate(columns)])


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def filled_counts(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Counts of the given values, zero where there are no rows; other values are left out."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    found = df.where(F.col(key).isin(list(values))).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return dim.join(found, key, "left").select(key, F.coalesce("c", F.lit(0)).alias("n"))


def content_groups(df: DataFrame, digest: Column, split: Column, label: Column, path: Column, least: int = 2) -> DataFrame:
    """Groups of equal digest with at least `least` different paths: members, splits, classes, smallest path.

    No list of members is collected, since a group may hold a third of all rows; members are the rows with the digest.
    """
    rows = df.select(digest.alias("digest"), split.alias("_s"), label.alias("_l"), path.alias("_p")).where("digest is not null").distinct()
    groups = rows.groupBy("digest").agg(
        F.count_distinct("_p").alias("n_members"), F.count_distinct("_s").alias("n_splits"), F.count_distinct("_l").alias("n_classes"), F.min("_p").alias("first_path")
    )
    return groups.where(F.col("n_members") >= least)


def group_breakdown(groups: DataFrame) -> DataFrame:
    """One row: groups and members by whether they cross splits and classes."""
    s, c = F.col("n_splits") > 1, F.col("n_classes") > 1
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("n_members"), F.lit(0)).alias("n_records"),
        F.count_if(s).alias("cross_split"),
        F.count_if(c).alias("cross_class"),
        F.count_if(s & c).alias("both"),
        F.count_if(s & ~c).alias("split_only"),
        F.count_if(~s & c).alias("class_only"),
        F.count_if(~s & ~c).alias("neither"),
        F.coalesce(F.max("n_members"), F.lit(0)).alias("largest"),
        F.coalesce(F.sum(F.col("n_members") - 1), F.lit(0)).alias("surplus"),
    )


def repeated(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys that several different rows' values share, with their number; null keys are left out."""
    return df.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collisions(df: DataFrame, value: str, key: Column) -> DataFrame:
    """Different values that share a key (as paths under case folding): the smallest, the largest and their number."""
    return df.select(F.col(value).alias("v"), key.alias("k")).where("v is not null").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last")).where("n > 1").drop("k")


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """One row: records, classes, largest and smallest class (by count, then name) and their ratio."""
    by = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    return by.agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("n_classes"),
        F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("largest"),
        F.min_by(label, F.struct(F.col("c"), F.col(label))).alias("smallest"),
        (F.max("c") / F.min("c")).alias("ratio"),
    )


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    """One row: the commonest label (ties by name), its accuracy p, and its macro F1 over all labels: 2p / (p + 1) / k."""
    by = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    one = by.agg(F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("label"), (F.max("c") / F.sum("c")).alias("accuracy"), F.count(F.lit(1)).alias("k"))
    p = F.col("accuracy")
    return one.select("label", "accuracy", (2 * p / (p + 1) / F.col("k")).alias("macro_f1"))


def coverage(df: DataFrame, present: Column) -> DataFrame:
    """One row: rows, rows with a value, the share of four digits, and a state: unavailable, ready (from 0.999), partial
    or none."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(present, F.lit(False))).alias("n_present"))
    share = F.try_divide(F.col("n_present"), F.col("n"))
    state = F.when(F.col("n") == 0, "unavailable").when(share >= 0.999, "ready").when(F.col("n_present") > 0, "partial").otherwise("none")
    return one.select("n", "n_present", F.round(share, 4).alias("share"), state.alias("state"))


def all_hold(df: DataFrame, condition: Column) -> DataFrame:
    """One row: whether the condition holds in every row; false for an empty table and for unknown values."""
    return df.agg(F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(False)).alias("holds"))


def spread_groups(df: DataFrame, group: str, over: str) -> DataFrame:
    """Groups whose rows stand under several values of a column: a leak, if the column is the split."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(over).alias("n_values"), F.count(F.lit(1)).alias("n")).where("n_values > 1")


def class_index(labels: DataFrame, label: str) -> DataFrame:
    """(label, idx): dense numbers from 0 in the order of the distinct labels, a bounded vocabulary."""
    return labels.select(label).where(F.col(label).isNotNull()).distinct().select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("idx"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): inverse frequencies n / (k * n_label), scaled to a mean of 1 over the labels."""
    by = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    raw = F.sum("n").over(Window.partitionBy(F.lit(1))) / (F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) * F.greatest("n", F.lit(1)))
    with_raw = by.select(label, "n", raw.alias("raw"))
    return with_raw.select(label, "n", (F.col("raw") / F.avg("raw").over(Window.partitionBy(F.lit(1)))).alias("weight"))
