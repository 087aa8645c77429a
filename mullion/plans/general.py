"""Queries p3 and p4 over the image manifests: differences between copies, and references to missing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions.paths import normal_path
from mullion.functions.records import boolean_form, digest, instant, instant_form, number_form
from mullion.operators.reconcile import compare_copies, conflicting_rows
from mullion.operators.references import orphans

NUMBERS = ("width", "height", "n_bytes")
BOOLEANS = ("is_corrupt", "has_leaf_id")
TEXTS = ("dataset", "split", "class_label", "mode", "source_url", "leaf_id")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fields(acquired: Column) -> dict[str, Column]:
    """The compared fields in one notation."""
    c = F.col
    return (
        {n: c(n) for n in TEXTS}
        | {"sha256": digest(c("sha256"))}
        | {n: number_form(c(n).cast("string")) for n in NUMBERS}
        | {n: boolean_form(c(n).cast("string")) for n in BOOLEANS}
        | {"acquired_at_utc": acquired}
    )


def _differences(spark: SparkSession, sf: str, carry: bool = False) -> DataFrame:
    held, rebuilt = _table(spark, sf, "plantvillage"), _table(spark, sf, "plantvillage_rebuilt")
    c = F.col
    return compare_copies(
        held,
        rebuilt,
        F.nullif(c("relpath"), F.lit("")),
        normal_path(c("relpath")),
        _fields(F.unix_micros("acquired_at_utc").cast("string")),
        _fields(instant_form(c("acquired_at_utc"))),
        key_name="relpath",
        carry={"shard_id": c("shard_id")} if carry else None,
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _differences(spark, sf)


def p3_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that have several different rows on a side, whose smallest p3_found compares: (relpath, side, n_forms)."""
    held, rebuilt = _table(spark, sf, "plantvillage"), _table(spark, sf, "plantvillage_rebuilt")
    c = F.col
    a = conflicting_rows(held, F.nullif(c("relpath"), F.lit("")), _fields(F.unix_micros("acquired_at_utc").cast("string")), "relpath")
    b = conflicting_rows(rebuilt, normal_path(c("relpath")), _fields(instant_form(c("acquired_at_utc"))), "relpath")
    return a.select("relpath", F.lit("expected").alias("side"), "n_forms").unionAll(b.select("relpath", F.lit("actual").alias("side"), "n_forms"))


def p3_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Missing and differing records per shard beside the latest earlier report's claims; extras are in p3_extra_claims."""
    found = _differences(spark, sf, carry=True).where("outcome <> 'extra_records'")
    now = found.groupBy(F.col("shard_id").cast("long").alias("shard_id")).agg(
        F.count_distinct(F.when(F.col("outcome") == "missing_records", F.col("relpath"))).alias("missing_records"),
        F.count_distinct(F.when(F.col("outcome") == "value_mismatches", F.col("relpath"))).alias("value_mismatches"),
    )
    claims = _table(spark, sf, "plantvillage_manifest_reconstruction").groupBy("shard_id").agg(
        F.max_by(F.struct("missing_records", "value_mismatches"), F.struct("run_at_utc", "run_id")).alias("c")
    )
    return claims.join(now, "shard_id", "full").select(
        "shard_id",
        F.coalesce(now.missing_records, F.lit(0)).alias("missing_records"),
        F.coalesce(now.value_mismatches, F.lit(0)).alias("value_mismatches"),
        F.col("c.missing_records").alias("claimed_missing"),
        F.col("c.value_mismatches").alias("claimed_mismatches"),
    )


def p3_extra_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Extra records claimed by each shard's latest earlier report, and those found, in the row whose shard is null.

    Rebuilt rows have no shard, and a record too many has no other row to take one from; so the found ones have one row
    for all shards, against which the claims can be held as a sum.
    """
    found = _differences(spark, sf).where("outcome = 'extra_records'").agg(F.count(F.lit(1)).alias("extra_records"))
    claims = _table(spark, sf, "plantvillage_manifest_reconstruction").groupBy("shard_id").agg(
        F.max_by(F.struct("extra_records"), F.struct("run_at_utc", "run_id")).alias("c")
    )
    none = F.lit(None).cast("long")
    rows = claims.select("shard_id", none.alias("extra_records"), F.col("c.extra_records").alias("claimed_extra"))
    rows = rows.unionByName(found.select(none.alias("shard_id"), "extra_records", none.alias("claimed_extra")))
    return rows.groupBy("shard_id").agg(F.max("extra_records").alias("extra_records"), F.max("claimed_extra").alias("claimed_extra"))


def _references(spark: SparkSession, sf: str) -> DataFrame:
    pairs, reviews = _table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs"), _table(spark, sf, "cross_dataset_near_duplicate_review")
    from_pairs = pairs.select(
        F.lit("leakage_plantvillage_vs_plantdoc_pairs").alias("table_name"),
        F.col("pair_row_id").alias("row_id"),
        F.col("detected_at_utc").alias("at"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("path")) for n in ("training_relpath", "evaluation_relpath")])).alias("r"),
    )
    from_reviews = reviews.select(
        F.lit("cross_dataset_near_duplicate_review").alias("table_name"),
        F.col("review_row_id").alias("row_id"),
        instant(F.col("reviewed_at")).alias("at"),
        F.struct(F.lit("evaluation_relative_path").alias("field_name"), F.col("evaluation_relative_path").alias("path")).alias("r"),
    )
    rows = from_pairs.unionByName(from_reviews)
    return rows.select("table_name", "row_id", "r.field_name", "at", normal_path(F.col("r.path")).alias("key"))


def _orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    held = [
        _table(spark, sf, t).select(F.nullif("relpath", F.lit("")).alias("key"), F.col("acquired_at_utc").alias("since"), F.col("removed_at_utc").alias("until"))
        for t in ("plantvillage", "plantdoc")
    ]
    return orphans(_references(spark, sf), held[0].unionByName(held[1]))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphan_rows(spark, sf).select("table_name", "row_id", "field_name").distinct()


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, field and month of the reference; month is null where the time is unknown."""
    rows = _orphan_rows(spark, sf).select("table_name", "row_id", "field_name", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM").alias("month")).distinct()
    return rows.groupBy("table_name", "field_name", "month").agg(F.count(F.lit(1)).alias("n_orphans"))


def p4_parent_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest paths by whether they are in normal form, which the orphan search takes for granted."""
    rows = _table(spark, sf, "plantvillage").select(F.lit("plantvillage").alias("table_name"), "relpath").unionAll(_table(spark, sf, "plantdoc").select(F.lit("plantdoc").alias("table_name"), "relpath"))
    normal = normal_path(F.col("relpath"))
    return rows.groupBy("table_name").agg(F.count("relpath").alias("n"), F.count_if(F.col("relpath").isNotNull() & ~normal.eqNullSafe(F.col("relpath"))).alias("n_other"))


QUERIES = {"p3_conflicts": p3_conflicts, "p4_parent_forms": p4_parent_forms, "p3_found": p3_found, "p3_claims": p3_claims, "p3_extra_claims": p3_extra_claims, "p4_found": p4_found, "p4_counts": p4_counts}

_PATH = r"nullif(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '^[\s\x{{00A0}}\x{{3000}}]+|[\s\x{{00A0}}\x{{3000}}]+$', '', 'g'), '[/\\]+', '/', 'g'), '^(\./)+', ''), '')"
_NUM = "coalesce(cast(try_cast(regexp_replace(coalesce(cast({0} as varchar), ''), '[\\s_]', '', 'g') as decimal(38,18)) as varchar), coalesce(cast({0} as varchar), ''))"
_P4_CASES = f"""
refs as (
  select 'leakage_plantvillage_vs_plantdoc_pairs' as table_name, pair_row_id as row_id, 'training_relpath' as field_name, {_PATH.format('training_relpath')} as k, detected_at_utc as t from leakage_plantvillage_vs_plantdoc_pairs
  union all select 'leakage_plantvillage_vs_plantdoc_pairs', pair_row_id, 'evaluation_relpath', {_PATH.format('evaluation_relpath')}, detected_at_utc from leakage_plantvillage_vs_plantdoc_pairs
  union all select 'cross_dataset_near_duplicate_review', review_row_id, 'evaluation_relative_path', {_PATH.format('evaluation_relative_path')},
    case when regexp_matches(reviewed_at, '^\\s*\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?(Z|[+-]\\d\\d:?\\d\\d)\\s*$') then cast(trim(reviewed_at) as timestamptz) end from cross_dataset_near_duplicate_review
), held as (
  select relpath as k, acquired_at_utc as s, removed_at_utc as u from plantvillage union all select relpath, acquired_at_utc, removed_at_utc from plantdoc
), cases as (
  select distinct table_name, row_id, field_name, t from refs where k is not null
  and not exists (select 1 from held where held.k = refs.k and (refs.t is null or ((held.s is null or held.s <= refs.t) and (held.u is null or refs.t < held.u))))
)"""
SQL = {
    "p3_found": f"""
with a as (select distinct relpath as k, coalesce(dataset,'') as dataset, coalesce(split,'') as split, coalesce(class_label,'') as class_label, coalesce(lower(trim(sha256)),'') as sha256,
  {_NUM.format('width')} as width, {_NUM.format('height')} as height, coalesce(mode,'') as mode, {_NUM.format('n_bytes')} as n_bytes, coalesce(lower(cast(is_corrupt as varchar)),'') as is_corrupt,
  coalesce(source_url,'') as source_url, coalesce(cast(epoch_us(acquired_at_utc) as varchar),'') as acquired_at_utc, coalesce(leaf_id,'') as leaf_id, coalesce(lower(cast(has_leaf_id as varchar)),'') as has_leaf_id from plantvillage where relpath <> ''),
b as (select distinct {_PATH.format('relpath')} as k, coalesce(dataset,'') as dataset, coalesce(split,'') as split, coalesce(class_label,'') as class_label, coalesce(lower(trim(sha256)),'') as sha256,
  {_NUM.format('width')} as width, {_NUM.format('height')} as height, coalesce(mode,'') as mode, {_NUM.format('n_bytes')} as n_bytes, coalesce(lower(is_corrupt),'') as is_corrupt,
  coalesce(source_url,'') as source_url, coalesce(cast(epoch_us(try_cast(acquired_at_utc as timestamptz)) as varchar), acquired_at_utc, '') as acquired_at_utc, coalesce(leaf_id,'') as leaf_id, coalesce(lower(has_leaf_id),'') as has_leaf_id from plantvillage_rebuilt),
j as (select a.k as ka, b.k as kb, a, b from a full join b on a.k = b.k)
select ka as relpath, 'missing_records' as outcome, '' as field_name from j where kb is null
union all select kb, 'extra_records', '' from j where ka is null and kb is not null
"""
    + "".join(
        f"union all select ka, 'value_mismatches', '{f}' from j where ka is not null and kb is not null and a.{f} <> b.{f}\n"
        for f in ("dataset", "split", "class_label", "sha256", "width", "height", "mode", "n_bytes", "is_corrupt", "source_url", "acquired_at_utc", "leaf_id", "has_leaf_id")
    ),
    "p4_found": f"with {_P4_CASES} select distinct table_name, row_id, field_name from cases",
    "p4_counts": f"with {_P4_CASES} select table_name, field_name, strftime(t at time zone 'UTC', '%Y-%m') as month, count(*) as n_orphans from cases group by 1, 2, 3",
}

SQL["p3_claims"] = f"""
with d as ({SQL["p3_found"]}), m as (select distinct relpath, shard_id from plantvillage),
n as (select shard_id, count(distinct d.relpath) filter (where outcome = 'missing_records') as missing_records, count(distinct d.relpath) filter (where outcome = 'value_mismatches') as value_mismatches from d join m on d.relpath = m.relpath where outcome <> 'extra_records' group by 1),
c as (select shard_id, arg_max((missing_records, value_mismatches), (run_at_utc, run_id)) as c from plantvillage_manifest_reconstruction group by 1)
select coalesce(n.shard_id, c.shard_id) as shard_id, coalesce(missing_records, 0) as missing_records, coalesce(value_mismatches, 0) as value_mismatches, c[1] as claimed_missing, c[2] as claimed_mismatches from n full join c on n.shard_id = c.shard_id"""

SQL["p3_extra_claims"] = f"""
with d as (select count(*) as n from ({SQL["p3_found"]}) where outcome = 'extra_records'),
c as (select shard_id, arg_max(row(extra_records), (run_at_utc, run_id)) as c from plantvillage_manifest_reconstruction group by 1),
r as (select shard_id, null::bigint as extra_records, c[1] as claimed_extra from c union all select null, n, null from d)
select shard_id, max(extra_records) as extra_records, max(claimed_extra) as claimed_extra from r group by 1"""

SQL["p3_conflicts"] = SQL["p3_found"].partition("j as (select a.k")[0].rstrip().rstrip(",") + """
select k as relpath, 'expected' as side, count(*) as n_forms from a group by 1 having count(*) > 1 union all select k, 'actual', count(*) from b where k is not null group by 1 having count(*) > 1"""
SQL["p4_parent_forms"] = f"""select t as table_name, count(relpath) as n, count(*) filter (where relpath is not null and relpath is distinct from {_PATH.format('relpath')}) as n_other
from (select 'plantvillage' as t, relpath from plantvillage union all select 'plantdoc', relpath from plantdoc) group by 1"""
