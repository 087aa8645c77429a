"""Duplicate remediation: one member kept per group, effective records, exclusions, and their verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_members(members: DataFrame, group: str, path: str, split: str, preferred: str) -> DataFrame:
    """(group, path) of the member to keep: the preferred split first, then the smallest path; an aggregate, no sort."""
    rows = members.where(F.col(group).isNotNull() & F.col(path).isNotNull())
    return rows.groupBy(group).agg(F.min(F.struct(~F.coalesce(F.col(split) == preferred, F.lit(False)), F.col(path).alias("p"))).getField("p").alias(path))


def effective_records(manifest: DataFrame, outcomes: DataFrame, path: str, kept: Column, overrides: dict[str, str]) -> DataFrame:
    """Manifest rows after the outcomes by path: excluded ones dropped, overridden columns replaced, others untouched.

    outcomes: unique by path. overrides maps a manifest column to the outcome column that replaces it where not empty.
    """
    o = outcomes.select(F.col(path).alias("_o"), kept.alias("_kept"), *[F.nullif(F.trim(F.col(v)), F.lit("")).alias(f"_v_{k}") for k, v in overrides.items()])
    j = manifest.join(o, F.col(path) == F.col("_o"), "left").where("_o is null or _kept")
    return j.select(*[F.coalesce(F.col(f"_v_{c}"), F.col(c)).alias(c) if c in overrides else F.col(c) for c in manifest.columns])


def excluded(records: DataFrame, exclusions: DataFrame, path: str, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records without the excluded paths, problems): an exclusion must name a record whose identity columns agree."""
    left = records.join(exclusions.select(path).distinct(), path, "left_anti")
    e = exclusions.select(F.col(path), *[F.col(c).alias(f"_e_{c}") for c in identity])
    j = e.join(records.select(F.col(path), F.lit(True).alias("_there"), *identity), path, "left")
    wrong = [F.when(F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"_e_{c}")), F.lit(c)) for c in identity]
    found = F.array_compact(F.array(F.when(F.col("_there").isNull(), F.lit("no such record")), *wrong))
    return left, j.select(path, F.explode(found).alias("problem")).distinct()


def verify_effective(manifest: DataFrame, effective: DataFrame, path: str, compared: Sequence[str]) -> DataFrame:
    """(path, outcome, field): records dropped, added, or changed, by field, between a manifest and its effective form."""
    a = manifest.groupBy(path).agg(F.min(F.struct(*[F.col(c) for c in compared])).alias("a"))
    b = effective.groupBy(F.col(path).alias("_p")).agg(F.min(F.struct(*[F.col(c) for c in compared])).alias("b"))
    j = a.join(b, F.col(path) == F.col("_p"), "full")

    def found(name: str, field: str = "") -> Column:
        return F.struct(F.lit(name).alias("outcome"), F.lit(field).alias("field"))

    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = [F.when(F.col("b").isNull(), found("dropped")), F.when(F.col("a").isNull(), found("added"))]
    out += [F.when(both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), found("changed", c)) for c in compared]
    return j.select(F.coalesce(F.col(path), F.col("_p")).alias(path), F.explode(F.array_compact(F.array(*out))).alias("o")).select(path, "o.outcome", "o.field")


def decision_counts(decisions: DataFrame, group: str, action: str) -> DataFrame:
    """(action, n_records, n_groups) of decisions; no action is an empty text."""
    return decisions.groupBy(F.coalesce(F.col(action), F.lit("")).alias("action")).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(group).alias("n_groups"))


def relabel_kinds(members: DataFrame, group: str, source: str, applied: str) -> DataFrame:
    """(group, kind): unchanged, in_group (another member's label) or outside_group, by the applied label."""
    rows = members.where(F.col(group).isNotNull()).select(group, F.col(source).alias("s"), F.nullif(F.trim(F.col(applied)), F.lit("")).alias("a"))
    by = rows.groupBy(group).agg(F.min("a").alias("applied"), F.count_distinct("s").alias("n"), F.min("s").alias("one"))
    own = rows.select(F.col(group).alias("_g"), F.col("s").alias("_s")).distinct()
    j = by.join(own, (F.col(group) == F.col("_g")) & (F.col("applied") == F.col("_s")), "left")
    kind = F.when(F.col("applied").isNull() | ((F.col("n") == 1) & (F.col("applied") == F.col("one"))), "unchanged").when(F.col("_s").isNotNull(), "in_group").otherwise("outside_group")
    return j.select(group, kind.alias("kind"))


def pair_verdicts(members: DataFrame, group: str, stored: str, decoded: str) -> DataFrame:
    """(group, n, verdict): byte-identical members, re-encoded ones (equal only when decoded), or different ones."""
    by = members.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(stored)).alias("s"), F.count_distinct(F.lower(decoded)).alias("d"))
    verdict = F.when((F.col("s") == 0) | (F.col("d") == 0), "unknown").when(F.col("s") == 1, "byte-identical").when(F.col("d") == 1, "re-encoded").otherwise("different")
    return by.select(group, "n", verdict.alias("verdict"))


def minted(fresh: DataFrame, held: DataFrame, key: str, number: str, order: Sequence[str], scratch) -> DataFrame:
    """Fresh rows that held lacks by key, numbered above held's highest number; no number is ever used twice."""
    from mullion.scale import numbered

    top = held.agg(F.coalesce(F.max(number), F.lit(0))).head()[0]
    new = fresh.join(held.select(key), key, "left_anti")
    return numbered(new, [], list(order), scratch, "_n").select(*new.columns, (F.col("_n") + F.lit(top)).alias(number))
