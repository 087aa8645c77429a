"""Differences between two copies of a table, and set equality by identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_side(df: DataFrame, side: int, key: Column, fields: dict[str, Column]) -> DataFrame:
    packed = F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in fields.items()])
    return df.select(key.alias("key"), F.lit(side).alias("side"), packed.alias("fields")).where(F.col("key").isNotNull())


def compare_copies(
    expected: DataFrame,
    actual: DataFrame,
    expected_key: Column,
    actual_key: Column,
    expected_fields: dict[str, Column],
    actual_fields: dict[str, Column],
    key_name: str = "key",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows missing on a side and fields that differ, as (key, outcome, field_name).

    Both sides are tagged, united and grouped once by key with one struct per side; generated higher-order SQL then
    compares the structs field by field. The aggregate keeps one struct per side and key, so that a key with a third
    of all rows is combined before the shuffle and needs no more memory than any other.

    The field columns bring each side to one notation; they are compared as texts, null as an empty text. Rows with a
    null key are no records. Repeated rows count once; of rows that differ under one key on one side the smallest
    struct is compared. Extra columns of either table are never read. An empty table on a side makes every key of the
    other missing or extra. `carry` adds columns of the expected side that go out with each row, null for extra rows.
    """
    carry = carry or {}
    names = list(expected_fields)
    if names != list(actual_fields):
        raise ValueError("both sides need the same fields in the same order")
    left = _one_side(expected.select("*", *[c.alias(f"_carry_{n}") for n, c in carry.items()]) if carry else expected, 0, expected_key, expected_fields | {f"_carry_{n}": F.col(f"_carry_{n}") for n in carry})
    right = _one_side(actual, 1, actual_key, actual_fields | {f"_carry_{n}": F.lit("") for n in carry})
    by_key = left.unionByName(right).groupBy("key").agg(
        F.min(F.when(F.col("side") == 0, F.col("fields"))).alias("a"),
        F.min(F.when(F.col("side") == 1, F.col("fields"))).alias("b"),
    )
    pairs = ", ".join(f"named_struct('f', '{n}', 'x', a.`{n}`, 'y', b.`{n}`)" for n in names)
    found = (
        "CASE WHEN b IS NULL THEN array(named_struct('outcome', 'missing_records', 'field_name', ''))"
        " WHEN a IS NULL THEN array(named_struct('outcome', 'extra_records', 'field_name', ''))"
        f" ELSE transform(filter(array({pairs}), p -> p.x <> p.y), p -> named_struct('outcome', 'value_mismatches', 'field_name', p.f)) END"
    )
    rows = by_key.select(F.col("key").alias(key_name), *[F.col(f"a._carry_{n}").alias(n) for n in carry], F.explode(F.expr(found)).alias("_d"))
    return rows.select(key_name, *carry, "_d.outcome", "_d.field_name")


def conflicting_rows(df: DataFrame, key: Column, fields: dict[str, Column], key_name: str = "key") -> DataFrame:
    """(key, n_forms): keys that have several different rows, of which compare_copies takes the smallest.

    Fields are compared as there; repeats are combined before the shuffle, and forms are counted, never collected.
    """
    forms = df.select(key.alias(key_name), *[F.coalesce(c.cast("string"), F.lit("")).alias(f"_f{i}") for i, c in enumerate(fields.values())]).where(F.col(key_name).isNotNull()).distinct()
    return forms.groupBy(key_name).agg(F.count(F.lit(1)).alias("n_forms")).where("n_forms > 1")


def reconcile_sets(fresh: DataFrame, persisted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identity sets compared both ways, as (keys, n_fresh, n_persisted, outcome); equal rows are left out.

    Counts decide nothing: equal counts with one identity exchanged give two rows. outcome is fresh_only,
    persisted_only or duplicate (on either side). Null identities are compared as values of their own.
    """
    tagged = fresh.select(*keys, F.lit(1).alias("_f"), F.lit(0).alias("_p")).unionByName(persisted.select(*keys, F.lit(0).alias("_f"), F.lit(1).alias("_p")))
    n = tagged.groupBy(*keys).agg(F.sum("_f").alias("n_fresh"), F.sum("_p").alias("n_persisted"))
    outcome = F.when(F.col("n_persisted") == 0, "fresh_only").when(F.col("n_fresh") == 0, "persisted_only").when((F.col("n_fresh") > 1) | (F.col("n_persisted") > 1), "duplicate")
    return n.withColumn("outcome", outcome).where(F.col("outcome").isNotNull())


def multiset_shortfall(needed: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of needed that held has too few of, repeats counted."""
    return needed.exceptAll(held)


def order_breaks(df: DataFrame, ordinal: str, order: Sequence[str], scratch) -> DataFrame:
    """Rows whose stored number is not their place in the wanted order: (order columns, ordinal, place)."""
    from mullion.scale import numbered

    return numbered(df.select(*order, ordinal), [], list(order), scratch, "place").where(F.col("place") != F.col(ordinal))


def position_differences(expected: DataFrame, actual: DataFrame, group: str, position: str, columns: Sequence[str]) -> DataFrame:
    """(group, position, outcome, field_name): rows of ordered packets that differ from what is expected at their place.

    Packets are compared place by place, not as sets: two rows exchanged are two differences. outcome is missing, extra,
    repeated (a place taken twice on a side) or changed, which has a row per field; nulls equal nulls only.
    """
    side = lambda t, s: t.groupBy(group, position).agg(F.count(F.lit(1)).alias(f"_n{s}"), *[F.min(F.col(c).cast("string")).alias(f"_{s}{i}") for i, c in enumerate(columns)])
    a, b = side(expected, "a"), side(actual, "b").withColumnsRenamed({group: "_g", position: "_p"})
    j = a.join(b, F.col(group).eqNullSafe(F.col("_g")) & F.col(position).eqNullSafe(F.col("_p")), "full")
    one = lambda o, f=None: F.struct(F.lit(o).alias("outcome"), F.lit(f).cast("string").alias("field_name"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")), one("changed", c)) for i, c in enumerate(columns)]))
    found = F.when(F.col("_nb").isNull(), F.array(one("missing"))).when(F.col("_na").isNull(), F.array(one("extra"))).when((F.col("_na") > 1) | (F.col("_nb") > 1), F.array(one("repeated"))).otherwise(changed)
    return j.select(F.coalesce(group, "_g").alias(group), F.coalesce(position, "_p").alias(position), F.explode(found).alias("d")).select(group, position, "d.*")


def named_facts(facts: dict[str, DataFrame]) -> DataFrame:
    """(name, value) from one-row tables, a row per column, as fact_column; a name that comes twice raises."""
    names = [f"{k}_{c}" for k, df in facts.items() for c in df.columns]
    if len(names) != len(set(names)):
        raise ValueError("a fact has two values")
    out = None
    for k, df in facts.items():
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(f"{k}_{c}").alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns])).alias("f")).select("f.*")
        out = rows if out is None else out.unionByName(rows)
    return out
