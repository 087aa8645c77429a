"""Crosswalks between label spaces: joins of normalised labels, and the labels that found no partner with the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_seeds(manifest: DataFrame, dataset: str, label: str, crop: Column, state: Column) -> DataFrame:
    """(dataset, label, crop, state): one row per distinct label of each dataset; null labels are left out.

    crop is an expression of `label`, state one of `label` and `crop`.
    """
    distinct = manifest.select(F.col(dataset).alias("dataset"), F.col(label).alias("label")).where("label is not null").distinct()
    return distinct.select("dataset", "label", crop.alias("crop")).select("dataset", "label", "crop", state.alias("state"))


def crosswalk(left: DataFrame, right: DataFrame) -> DataFrame:
    """(crop, state, left_label, right_label, included, reason) over both label spaces (label, crop, state).

    Labels with the same crop and state match. Any other label comes out once, with why: no crop, the crop is unknown to
    the other side, or its state is. Both spaces are vocabularies; one full join does all.
    """
    a = left.select(F.col("label").alias("left_label"), "crop", "state")
    b = right.select(F.col("label").alias("right_label"), "crop", "state")
    j = a.join(b, (a.crop == b.crop) & (a.state == b.state) & (a.crop != ""), "full")
    rows = j.select(F.coalesce(a.crop, b.crop).alias("crop"), F.coalesce(a.state, b.state).alias("state"), "left_label", "right_label")
    crops_a, crops_b = left.select(F.col("crop").alias("_ca")).distinct(), right.select(F.col("crop").alias("_cb")).distinct()
    rows = rows.join(crops_a, F.col("crop") == F.col("_ca"), "left").join(crops_b, F.col("crop") == F.col("_cb"), "left")
    both = F.col("left_label").isNotNull() & F.col("right_label").isNotNull()
    reason = F.when(both, "").when(F.col("crop") == "", "no crop").when(F.col("_ca").isNull() | F.col("_cb").isNull(), "crop only on one side").otherwise("state only on one side")
    return rows.select("crop", "state", "left_label", "right_label", both.alias("included"), reason.alias("reason"))


def broken_dependencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand with several values, where each should have one: (key, n_values, first, last)."""
    by = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("first"), F.max(value).alias("last"))
    return by.where("n_values > 1")


def grouped_labels(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, members): the sorted distinct values of each key, of a bounded vocabulary."""
    return df.where(F.col(key).isNotNull()).select(key, value).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), "|").alias("members"))


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows as they are, and the new rows whose keys they lack."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def merge_decisions(fresh: DataFrame, held: DataFrame, key: str, columns: Sequence[str], decided: str) -> DataFrame:
    """Fresh rows with the columns decided before, and an outcome per row.

    outcome: kept (a held row of the key), new, or lost: a decided row whose key is no longer found, which callers must
    treat as drift. Undecided rows that are no longer found are dropped.
    """
    f = fresh.select(F.col(key), *[c for c in fresh.columns if c != key and c not in columns])
    h = held.select(F.col(key).alias("_k"), *columns)
    j = f.join(h, F.col(key) == F.col("_k"), "full")
    outcome = F.when(F.col(key).isNull(), "lost").when(F.col("_k").isNull(), "new").otherwise("kept")
    j = j.withColumn("outcome", outcome).where((F.col("outcome") != "lost") | (F.coalesce(F.col(decided), F.lit("")) != ""))
    return j.select(F.coalesce(F.col(key), F.col("_k")).alias(key), *[c for c in f.columns if c != key], *columns, "outcome")


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, change): keys added, removed or changed between two snapshots."""
    j = old.select(F.col(key).alias("_o"), F.col(value).alias("old")).join(new.select(F.col(key).alias("_n"), F.col(value).alias("new")), F.col("_o") == F.col("_n"), "full")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select(F.coalesce("_o", "_n").alias(key), "old", "new", kind.alias("change")).where("change is not null")
