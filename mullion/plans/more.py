"""Further queries: generated hash tables, interpolated curves, order and numbering, verdicts, facts and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from mullion.operators import calibration, generators, metrics, profile, reconcile, remediation, rules
from mullion.plans.evaluation import P, pred_sql, predictions
from mullion.plans.manifests import M, manifest, rounded, table
from mullion.scale import Scratch

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _expected(kind: str, strategy: str, found: str) -> str:
    return f"select '{kind}' as kind, cast(n as bigint) as n, '{strategy}' as strategy, cast(n * (n - 1) // 2 as bigint) as possible, cast({found} as bigint) as found from (values (300), (1000)) v(n)"


@query("hash_benchmark_dense", _expected("dense", "banded", "n * (n - 1) // 2"))
def _(spark, sf):
    return generators.search_counts(spark, (300, 1000), "dense", 6, "banded")


@query("hash_benchmark_random", _expected("random", "banded", "0"))
def _(spark, sf):
    return generators.search_counts(spark, (300, 1000), "random", 6, "banded")


@query("hash_benchmark_band", _expected("band", "blocked", "0"))
def _(spark, sf):
    return generators.search_counts(spark, (300, 1000), "band", 2, "blocked")


#: Sizes and threshold of the original benchmark. No SQL: the tables' hashes are Spark's; tests compare all pairs.
SURVEY_SIZES, SURVEY_THRESHOLD = (1000, 10_000), 6


@query("hash_survey_dense")
def _(spark, sf):
    return generators.search_counts(spark, SURVEY_SIZES, "dense", SURVEY_THRESHOLD, "banded")


@query("hash_survey_random")
def _(spark, sf):
    return generators.search_counts(spark, SURVEY_SIZES, "random", SURVEY_THRESHOLD, "banded")


@query("hash_survey_band")
def _(spark, sf):
    return generators.search_counts(spark, SURVEY_SIZES, "band", SURVEY_THRESHOLD, "banded")


CURVE = " union all ".join(f"select 'm{r}' as run, cast(y_true as double) / 5 + 0.1 as x, round(avg(cast(correct as integer)), 9) as y from {pred_sql(r)} group by 2" for r in range(3))


def _curves(spark, sf):
    out = None
    for r in range(3):
        c = predictions(spark, sf, r).groupBy((F.col("y_true").cast("double") / 5 + 0.1).alias("x")).agg(F.round(F.avg(F.col("correct").cast("int")), 9).alias("y")).select(F.lit(f"m{r}").alias("run"), "x", "y")
        out = c if out is None else out.unionByName(c)
    return out


SEGMENTS = f"(select run, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from ({CURVE}) window w as (partition by run order by x))"
GRID = f"(select run, g as point, y0 + (y1 - y0) * (g / cast(96 as double) - x0) / (x1 - x0) as y, row_number() over (partition by run, g order by x0 desc) as k from {SEGMENTS} join range(1, 97) r(g) on g / cast(96 as double) >= x0 and g / cast(96 as double) <= x1)"


@query("interpolated_curves", f"select run, cast(point as integer) as point, round(point / cast(96 as double), 6) as x, round(y, 6) as y from {GRID} where k = 1")
def _(spark, sf):
    return rounded(calibration.interpolated(_curves(spark, sf), "run", "x", "y"))


@query("interpolated_band", f"select cast(point as integer) as point, round(avg(y), 6) as y_mean, round(stddev_samp(y), 6) as y_sd, count(*) as y_n from {GRID} where k = 1 group by 1")
def _(spark, sf):
    return rounded(metrics.mean_sd(calibration.interpolated(_curves(spark, sf), "run", "x", "y"), ["point"], ["y"]))


@query("confidence_tiers", f"select case when conf < 0.05 then null when conf <= 0.25 then 'low' when conf <= 0.75 then 'middle' when conf <= 1.0 then 'high' end as tier, count(*) as n from {P} group by 1")
def _(spark, sf):
    tier = calibration.tiers(F.col("conf"), [0.05, 0.25, 0.75, 1.0], ["low", "middle", "high"])
    return predictions(spark, sf).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("order_breaks", "select o_orderdate, o_orderkey, o_orderkey as ordinal, place from (select o_orderdate, o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as place from orders) where place <> o_orderkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", F.col("o_orderkey").alias("ordinal"))
    return reconcile.order_breaks(o, "ordinal", ["o_orderdate", "o_orderkey"], Scratch(spark))


@query("encoding_verdicts", "select group_id, count(*) as n, case when count(distinct lower(byte_sha256)) = 0 or count(distinct lower(decoded_rgb_sha256)) = 0 then 'unknown' when count(distinct lower(byte_sha256)) = 1 then 'byte-identical' when count(distinct lower(decoded_rgb_sha256)) = 1 then 're-encoded' else 'different' end as verdict from plantdoc_internal_duplicate_resolution where group_id is not null group by 1")
def _(spark, sf):
    return remediation.pair_verdicts(table(spark, sf, "plantdoc_internal_duplicate_resolution"), "group_id", "byte_sha256", "decoded_rgb_sha256")


@query("minted_numbers", "with h as (select review_row_id as n, canonical_pair_id as id from cross_dataset_near_duplicate_review), f as (select distinct canonical_pair_id as id from leakage_plantvillage_vs_plantdoc_pairs where canonical_pair_id is not null) select id, (select max(n) from h) + row_number() over (order by id) as n from f where id not in (select id from h where id is not null)")
def _(spark, sf):
    held = table(spark, sf, "cross_dataset_near_duplicate_review").select(F.col("canonical_pair_id").alias("id"), F.col("review_row_id").alias("n"))
    fresh = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").where("canonical_pair_id is not null").select(F.col("canonical_pair_id").alias("id")).distinct()
    return remediation.minted(fresh, held, "id", "n", ["id"], Scratch(spark))


@query("named_facts", f"select 'records_n' as name, cast(count(*) as varchar) as value from {M} union all select 'leaf_n', cast(count(*) as varchar) from plantvillage union all select 'leaf_n_present', cast(count(*) filter (where has_leaf_id) as varchar) from plantvillage")
def _(spark, sf):
    records = manifest(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    leaf = profile.coverage(table(spark, sf, "plantvillage"), F.col("has_leaf_id")).select("n", "n_present")
    return reconcile.named_facts({"records": records, "leaf": leaf})


@query("pairs_before_images", "with d as (select relpath, min(acquired_at_utc) as r from plantdoc group by 1), p as (select evaluation_relpath, detected_at_utc from leakage_plantvillage_vs_plantdoc_pairs) select case when d.relpath is null then 'no reference' when detected_at_utc is null then 'no time' else 'too early' end as problem, count(*) as n from p left join d on evaluation_relpath = d.relpath where d.relpath is null or detected_at_utc is null or detected_at_utc < r group by 1")
def _(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").select(F.col("evaluation_relpath").alias("relpath"), "detected_at_utc")
    return rules.before_reference(p, table(spark, sf, "plantdoc"), "relpath", "detected_at_utc", "acquired_at_utc").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("source_addresses", "select source_url, case when trim(coalesce(source_url, '')) = '' then 'missing' when not regexp_matches(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://') then 'no address' when not regexp_matches(source_url, '^https?://') then 'scheme' end as problem, count(*) as n from plantvillage group by 1, 2")
def _(spark, sf):
    return table(spark, sf, "plantvillage").groupBy("source_url", rules.url_problem(F.col("source_url")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))
