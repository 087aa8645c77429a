"""Queries on labels, rules, reviews, remediation and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions import text
from mullion.functions.paths import path_form
from mullion.functions.records import digest, split_name
from mullion.operators import crosswalk, reconcile, remediation, rules, splits
from mullion.plans.manifests import manifest, man_sql, table
from mullion.scale import Scratch

QUERIES, SQL = {}, {}
M, D = man_sql(), man_sql("plantdoc")

#: Crop names of the test data, the longer spelling first.
ALIASES = [(a, a) for a in ("almond", "barley", "cassava", "chickpea", "fig", "guava", "hazelnut", "lentil", "mango", "okra", "olive", "papaya", "quince")] + [("açaí", "acai")]
TOKENS = ["tbd", "unknown", "n/a", "pending", "not available", "to be supplied"]
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "home": r"/home/[^/\s]+", "special": r"<\|[a-z]+\|>", "image": r"[A-Za-z]+_[0-9]{4}\.(?:JPG|png)"}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


FORM = "lower(trim(regexp_replace({0}, '[_\\-\\s]+', ' ', 'g')))"
CROP = "case " + " ".join(f"when regexp_matches(form, '(^|[^\\p{{L}}\\p{{N}}_]){a}($|[^\\p{{L}}\\p{{N}}_])') then '{n}'" for a, n in ALIASES) + " else '' end"
REST = "coalesce(nullif(array_to_string([w for w in string_split(form, ' ') if w <> 'leaf' and w <> case when crop = 'acai' then 'açaí' else crop end], ' '), ''), form)"


def labels_sql(src: str) -> str:
    inner = f"(select *, {CROP} as crop from (select distinct class_label as label, {FORM.format('class_label')} as form from {src} where class_label is not null))"
    return f"(select label, form, crop, case when form like '%healthy%' then 'healthy' else {REST} end as state from {inner})"


def labels(spark: SparkSession, sf: str, name: str) -> DataFrame:
    form = text.label_form(F.col("label"))
    seeds = crosswalk.label_seeds(table(spark, sf, name), "dataset", "class_label", text.first_alias(form, ALIASES), text.remainder(form, ALIASES, F.col("crop")))
    # The vocabulary is read several times by a crosswalk, the manifest once.
    return Scratch(spark).keep(seeds.select("label", "crop", "state").distinct(), "labels")


@query("label_forms", f"select label, form, crop, state, lower(replace(replace(crop || '__' || state, ' ', '_'), ',', '')) as name from {labels_sql('plantdoc')}")
def _(spark, sf):
    d = labels(spark, sf, "plantdoc")
    return d.select("label", text.label_form(F.col("label")).alias("form"), "crop", "state", text.canonical_name(F.col("crop"), F.col("state")).alias("name"))


CW = f"""(select coalesce(a.crop, b.crop) as crop, coalesce(a.state, b.state) as state, a.label as left_label, b.label as right_label, a.label is not null and b.label is not null as included,
case when a.label is not null and b.label is not null then '' when coalesce(a.crop, b.crop) = '' then 'no crop'
when coalesce(a.crop, b.crop) not in (select crop from {labels_sql('plantvillage')}) or coalesce(a.crop, b.crop) not in (select crop from {labels_sql('plantdoc')}) then 'crop only on one side' else 'state only on one side' end as reason
from {labels_sql('plantvillage')} a full join {labels_sql('plantdoc')} b on a.crop = b.crop and a.state = b.state and a.crop <> '')"""


def _crosswalk(spark, sf):
    return crosswalk.crosswalk(labels(spark, sf, "plantvillage"), labels(spark, sf, "plantdoc"))


@query("label_crosswalk", f"select * from {CW} where included")
def _(spark, sf):
    return _crosswalk(spark, sf).where("included")


@query("label_crosswalk_remainder", f"select crop, state, left_label, right_label, reason from {CW} where not included")
def _(spark, sf):
    return _crosswalk(spark, sf).where("not included").select("crop", "state", "left_label", "right_label", "reason")


@query("crosswalk_coverage", f"select included, reason, count(*) as n from {CW} group by 1, 2")
def _(spark, sf):
    return _crosswalk(spark, sf).groupBy("included", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("labels_by_crop", f"select crop, string_agg(label, '|' order by label) as members from {labels_sql('plantvillage')} group by 1")
def _(spark, sf):
    return crosswalk.grouped_labels(labels(spark, sf, "plantvillage"), "crop", "label")


@query("broken_label_names", "select sha256, count(distinct class_label) as n_values, min(class_label) as first, max(class_label) as last from plantdoc where sha256 is not null group by 1 having count(distinct class_label) > 1")
def _(spark, sf):
    return crosswalk.broken_dependencies(table(spark, sf, "plantdoc"), "sha256", "class_label")


LEVELS = f"""(select record_id, unnest([x for x in [case when coalesce(length(sha256) <> 64, true) then {{'level': 'error', 'message': 'digest is not complete'}} end, case when coalesce(is_corrupt, true) then {{'level': 'warning', 'message': 'file is corrupt'}} end,
case when coalesce(split not in ('train', 'val', 'test'), true) then {{'level': 'error', 'message': 'no split'}} end, case when coalesce(width < 32, true) then {{'level': 'warning', 'message': 'no usable width'}} end] if x is not null]) as v from {M})"""


def manifest_rules():
    c = F.col
    return [
        ("error", "digest is not complete", F.length("sha256") != 64),
        ("warning", "file is corrupt", c("is_corrupt")),
        ("error", "no split", ~c("split").isin("train", "val", "test")),
        ("warning", "no usable width", c("width") < 32),
    ]


@query("manifest_violations", f'select v.level as level, cast(record_id as varchar) as "where", v.message as message from {LEVELS}')
def _(spark, sf):
    return rules.violations(manifest(spark, sf), manifest_rules(), F.col("record_id").cast("string"))


@query("violation_counts", f"select v.level as level, v.message as message, count(*) as n from {LEVELS} group by 1, 2")
def _(spark, sf):
    return rules.counts(rules.violations(manifest(spark, sf), manifest_rules(), F.col("record_id").cast("string")))


@query("passing_records", f"select count(*) as n from {M} where length(sha256) = 64 and split in ('train', 'val', 'test')")
def _(spark, sf):
    return rules.passing(manifest(spark, sf), manifest_rules()).agg(F.count(F.lit(1)).alias("n"))


ISO = "^\\s*\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?\\s*(Z|z|[+-]\\d{2}:?\\d{2}|[+-]\\d{2})?\\s*$"


@query("review_time_problems", f"select p as problem, count(*) as n from (select case when trim(coalesce(reviewed_at, '')) = '' then 'missing' when not regexp_matches(reviewed_at, '{ISO}') then 'malformed' when not regexp_matches(reviewed_at, '(Z|z|[+-]\\d{{2}}:?\\d{{2}}|\\d[+-]\\d{{2}})\\s*$') or regexp_matches(reviewed_at, '^\\S+[ T]\\d\\d:\\d\\d$') then 'no offset' end as p from (select distinct * from cross_dataset_near_duplicate_review)) group by 1")
def _(spark, sf):
    r = table(spark, sf, "cross_dataset_near_duplicate_review").distinct()
    return r.groupBy(rules.timestamp_problem(F.col("reviewed_at")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("blank_decisions", "select review_row_id, human_decision from (select distinct review_row_id, human_decision, decision_reason from cross_dataset_near_duplicate_review) where trim(coalesce(human_decision, '')) <> '' and trim(coalesce(decision_reason, '')) = ''")
def _(spark, sf):
    r = table(spark, sf, "cross_dataset_near_duplicate_review").select("review_row_id", "human_decision", "decision_reason").distinct()
    return r.where(~text.blank(F.col("human_decision")) & text.blank(F.col("decision_reason"))).select("review_row_id", "human_decision")


@query("placeholder_notes", "select coalesce(trim(notes), '') = '' or lower(trim(notes)) in ('tbd', 'unknown', 'n/a', 'pending', 'not available', 'to be supplied') as placeholder, count(*) as n from leakage_plantvillage_vs_plantdoc_pairs group by 1")
def _(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs")
    return p.groupBy(text.is_placeholder(F.col("notes"), TOKENS).alias("placeholder")).agg(F.count(F.lit(1)).alias("n"))


@query("embedded_tokens", "select case when regexp_matches(x, '(^|\\W)unknown($|\\W)') then 'unknown' when regexp_matches(x, '(^|\\W)pending($|\\W)') then 'pending' end as token, count(*) as n from (select lower(review_status || ' ' || classification) as x from leakage_plantvillage_vs_plantdoc_pairs) group by 1")
def _(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs")
    return p.groupBy(text.embedded_token(F.concat("review_status", F.lit(" "), "classification"), TOKENS).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("text_scan", "select name, found, count(*) as n from (" + " union all ".join(f"select '{n}' as name, unnest(regexp_extract_all(text, '{p}')) as found from documents" for n, p in PATTERNS.items()) + ") group by 1, 2")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.explode(text.scan(F.col("text"), PATTERNS)).alias("s"))
    return d.groupBy("s.name", "s.found").agg(F.count(F.lit(1)).alias("n"))


@query("numbers_in_texts", "select doc_id, len(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?')) as n from documents where text is not null")
def _(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(text.numbers(F.col("text"))).cast("long").alias("n"))


@query("figure_citations", "select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'Fig\\. [A-Z]?\\d+'))), '|') as cited from documents where regexp_matches(text, 'Fig\\. [A-Z]?\\d+')")
def _(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike(r"Fig\. [A-Z]?\d+"))
    return d.select("doc_id", F.array_join(text.cited([F.col("text")], r"Fig\. [A-Z]?\d+"), "|").alias("cited"))


@query("mentioned_word", "select count(*) as n from documents where regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])halo($|[^A-Za-z0-9_])')")
def _(spark, sf):
    return table(spark, sf, "documents").where(text.mentions(F.col("text"), "halo")).agg(F.count(F.lit(1)).alias("n"))


@query("denied_sources", "select source, count(*) as n from documents where regexp_replace(lower(trim(source)), '[\\s_-]+', ' ', 'g') like '%lot 07%' group by 1")
def _(spark, sf):
    return table(spark, sf, "documents").where(text.denied(F.col("source"), ["LOT_07"])).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("reviewer_identities", "select lower(trim(coalesce(reviewer, ''))) as who, count(*) as n from cross_dataset_near_duplicate_review group by 1")
def _(spark, sf):
    return table(spark, sf, "cross_dataset_near_duplicate_review").groupBy(text.identity_key(F.col("reviewer")).alias("who")).agg(F.count(F.lit(1)).alias("n"))


PA = "(select distinct canonical_pair_id as id, lower(training_sha256) as t, lower(evaluation_sha256) as e, hamming_distance as d from leakage_plantvillage_vs_plantdoc_pairs where canonical_pair_id is not null)"
RV = "(select distinct review_row_id, canonical_pair_id as id, lower(training_sha256) as t, lower(evaluation_sha256) as e, phash_distance as d from cross_dataset_near_duplicate_review where canonical_pair_id is not null)"


def pair_sides(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").where("canonical_pair_id is not null")
    p = p.select(F.col("canonical_pair_id").alias("id"), F.lower("training_sha256").alias("t"), F.lower("evaluation_sha256").alias("e"), F.col("hamming_distance").alias("d")).distinct()
    r = table(spark, sf, "cross_dataset_near_duplicate_review").where("canonical_pair_id is not null")
    return r.select("review_row_id", F.col("canonical_pair_id").alias("id"), F.lower("training_sha256").alias("t"), F.lower("evaluation_sha256").alias("e"), F.col("phash_distance").alias("d")).distinct().drop("review_row_id"), p


AUTH = f"""with a as (select id, count(*) as na, min((t, e, d)) as r from (select id, t, e, d from {RV}) group by 1), b as (select id, count(*) as nb, min((t, e, d)) as r from {PA} group by 1),
j as (select coalesce(a.id, b.id) as id, na, nb, a.r as ra, b.r as rb from a full join b on a.id = b.id)
select id, 'unknown' as problem, '' as field from j where nb is null union all select id, 'unclaimed', '' from j where na is null union all select id, 'repeated', '' from j where na > 1 union all select id, 'repeated identity', '' from j where nb > 1"""


@query("review_authentication", AUTH)
def _(spark, sf):
    claims, known = pair_sides(spark, sf)
    return rules.authenticate(claims, known, ["id"], ["t", "e", "d"]).where("problem <> 'mismatch'")


@query("review_mismatches", f"select id, field from (select a.id, unnest([x for x in [case when a.t is distinct from b.t then 't' end, case when a.e is distinct from b.e then 'e' end, case when a.d is distinct from b.d then 'd' end] if x is not null]) as field from (select id, any_value(t) as t, any_value(e) as e, any_value(d) as d from {RV} group by 1 having count(*) = 1) a join (select id, any_value(t) as t, any_value(e) as e, any_value(d) as d from {PA} group by 1 having count(*) = 1) b on a.id = b.id)")
def _(spark, sf):
    claims, known = pair_sides(spark, sf)
    found = rules.authenticate(claims, known, ["id"], ["t", "e", "d"])
    twice = found.where("problem in ('repeated', 'repeated identity')").select("id")
    return found.where("problem = 'mismatch'").join(twice, "id", "left_anti").select("id", "field")


@query("pair_endpoints", f"""select r as pair_row_id, unnest([x for x in [case when t is null then 'training endpoint is not in the manifest' end, case when e is null then 'evaluation endpoint is not in the manifest' end, case when coalesce(d not between 0 and 6, true) then 'distance is not from 0 to 6' end] if x is not null]) as problem
from (select distinct p.pair_row_id as r, m.relpath as t, d.relpath as e, hamming_distance as d from (select distinct pair_row_id, training_relpath, evaluation_relpath, hamming_distance from leakage_plantvillage_vs_plantdoc_pairs) p left join (select distinct relpath from plantvillage) m on p.training_relpath = m.relpath left join (select distinct relpath from plantdoc) d on p.evaluation_relpath = d.relpath)""")
def _(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").select("pair_row_id", "training_relpath", "evaluation_relpath", "hamming_distance").distinct()
    m = table(spark, sf, "plantvillage").select(F.col("relpath").alias("training_relpath"), F.lit(True).alias("t")).distinct()
    d = table(spark, sf, "plantdoc").select(F.col("relpath").alias("evaluation_relpath"), F.lit(True).alias("e")).distinct()
    j = p.join(m, "training_relpath", "left").join(d, "evaluation_relpath", "left")
    checks = [
        ("error", "training endpoint is not in the manifest", F.col("t").isNull()),
        ("error", "evaluation endpoint is not in the manifest", F.col("e").isNull()),
        ("error", "distance is not from 0 to 6", ~F.col("hamming_distance").between(0, 6)),
    ]
    return rules.violations(j, checks, F.col("pair_row_id")).select(F.col("where").alias("pair_row_id"), F.col("message").alias("problem"))


@query("pair_set_difference", f"with f as (select id, count(*) as n from {PA} group by 1), p as (select id, count(*) as n from (select distinct review_row_id, id from {RV}) group by 1) select coalesce(f.id, p.id) as id, cast(coalesce(f.n, 0) as bigint) as n_fresh, cast(coalesce(p.n, 0) as bigint) as n_persisted, case when p.id is null then 'fresh_only' when f.id is null then 'persisted_only' else 'duplicate' end as outcome from f full join p on f.id = p.id where f.id is null or p.id is null or f.n > 1 or p.n > 1")
def _(spark, sf):
    _, p = pair_sides(spark, sf)
    r = table(spark, sf, "cross_dataset_near_duplicate_review").where("canonical_pair_id is not null").select("review_row_id", F.col("canonical_pair_id").alias("id")).distinct()
    return reconcile.reconcile_sets(p, r, ["id"])


@query("digest_shortfall", "select lower(byte_sha256) as sha256 from (select distinct group_id, active_relative_path, byte_sha256 from plantdoc_internal_duplicate_resolution) except all select lower(sha256) from (select distinct relpath, sha256 from plantdoc)")
def _(spark, sf):
    need = table(spark, sf, "plantdoc_internal_duplicate_resolution").select("group_id", "active_relative_path", "byte_sha256").distinct().select(F.lower("byte_sha256").alias("sha256"))
    held = table(spark, sf, "plantdoc").select("relpath", "sha256").distinct().select(F.lower("sha256").alias("sha256"))
    return reconcile.multiset_shortfall(need, held)


@query("class_readiness", f"with p as (select class_label, count(*) as n, count(*) filter (where split = 'test') as done from (select distinct class_label, split from {D} where class_label is not null) group by 1), e as (select distinct label from {labels_sql('plantdoc')} where label not like '%leaf' union select 'Tamarind leaf') select coalesce(class_label, label) as class_label, case when class_label is null then 'missing' when label is null then 'unexpected' when n > 1 then 'repeated' else 'not decided' end as problem from p full join e on class_label = label where class_label is null or label is null or n > 1 or done = 0")
def _(spark, sf):
    present = manifest(spark, sf, "plantdoc").select("class_label", "split").where("class_label is not null").distinct()
    wanted = labels(spark, sf, "plantdoc").where("label not like '%leaf'").select(F.col("label").alias("class_label")).union(spark.createDataFrame([("Tamarind leaf",)], "class_label string"))
    return rules.readiness(present, wanted, "class_label", "split", ["test"])


@query("gate_status", f"select cast(2 as bigint) as n_checks, cast(a + b as bigint) as n_problems, case when a + b > 0 then 'fail' else 'pass' end as status from (select (select count(*) from {M} where coalesce(length(sha256) <> 64, true)) as a, (select count(*) from (select sha256 from {M} where sha256 is not null group by 1 having count(distinct split) > 1)) as b)")
def _(spark, sf):
    m = manifest(spark, sf)
    a = m.where(F.coalesce(F.length("sha256") != 64, F.lit(True))).agg(F.lit("digests").alias("check"), F.count(F.lit(1)).alias("n_problems"))
    leaks = m.where("sha256 is not null").groupBy("sha256").agg(F.count_distinct("split").alias("n")).where("n > 1")
    return rules.gate(a.unionByName(leaks.agg(F.lit("leaks").alias("check"), F.count(F.lit(1)).alias("n_problems"))))


@query("shared_rationales", "select decision_reason as value, count(distinct group_id) as n_groups from plantdoc_internal_duplicate_resolution where decision_reason <> '' group by 1 having count(distinct group_id) > 1")
def _(spark, sf):
    return rules.shared_values(table(spark, sf, "plantdoc_internal_duplicate_resolution"), "group_id", F.col("decision_reason"))


RES = "(select distinct group_id, active_relative_path as path, lower(trim(source_split)) as split, source_class_label, effective_class_label, effective_split, remediation_action from plantdoc_internal_duplicate_resolution)"


def resolution(spark, sf):
    t = table(spark, sf, "plantdoc_internal_duplicate_resolution")
    return t.select("group_id", F.col("active_relative_path").alias("path"), split_name(F.col("source_split")).alias("split"), "source_class_label", "effective_class_label", "effective_split", "remediation_action").distinct()


@query("canonical_members", f"select group_id, arg_min(path, (case when coalesce(split = 'train', false) then 0 else 1 end, path)) as path from {RES} where group_id is not null and path is not null group by 1")
def _(spark, sf):
    return remediation.canonical_members(resolution(spark, sf), "group_id", "path", "split", "train")


@query("decision_counts", f"select coalesce(remediation_action, '') as action, count(*) as n_records, count(distinct group_id) as n_groups from {RES} group by 1")
def _(spark, sf):
    return remediation.decision_counts(resolution(spark, sf), "group_id", "remediation_action")


@query("relabel_kinds", f"""with g as (select group_id, min(nullif(trim(effective_class_label), '')) as a, count(distinct source_class_label) as n, min(source_class_label) as one from {RES} where group_id is not null group by 1)
select group_id, case when a is null or (n = 1 and a = one) then 'unchanged' when exists (select 1 from {RES} r where r.group_id = g.group_id and r.source_class_label = g.a) then 'in_group' else 'outside_group' end as kind from g""")
def _(spark, sf):
    return remediation.relabel_kinds(resolution(spark, sf), "group_id", "source_class_label", "effective_class_label")


OUT = f"(select path, max(remediation_action) as act, max(nullif(trim(effective_class_label), '')) as lab from {RES} where path is not null group by 1)"
DOCS = "(select distinct relpath as path, class_label, lower(trim(sha256)) as sha256 from plantdoc where relpath is not null)"


def outcomes(spark, sf):
    r = resolution(spark, sf).where("path is not null")
    return r.groupBy("path").agg(F.max("remediation_action").alias("act"), F.max(F.nullif(F.trim("effective_class_label"), F.lit(""))).alias("lab"))


def doc_records(spark, sf):
    return table(spark, sf, "plantdoc").select(F.col("relpath").alias("path"), "class_label", digest(F.col("sha256")).alias("sha256")).where("path is not null").distinct()


def effective(spark, sf):
    return remediation.effective_records(doc_records(spark, sf), outcomes(spark, sf), "path", F.coalesce(F.col("act") != "dropped", F.lit(True)), {"class_label": "lab"})


EFF = f"(select d.path, coalesce(o.lab, d.class_label) as class_label, d.sha256 from {DOCS} d left join {OUT} o on d.path = o.path where o.path is null or coalesce(o.act <> 'dropped', true))"


@query("effective_records", f"select * from {EFF}")
def _(spark, sf):
    return effective(spark, sf)


@query("effective_verification", f"""with a as (select path, min((class_label, sha256)) as r from {DOCS} group by 1), b as (select path, min((class_label, sha256)) as r from {EFF} group by 1)
select a.path, 'dropped' as outcome, '' as field from a anti join b on a.path = b.path
union all select a.path, 'changed', 'class_label' from a join b on a.path = b.path where (select min(class_label) from {DOCS} d where d.path = a.path) is distinct from (select min(class_label) from {EFF} e where e.path = a.path)""")
def _(spark, sf):
    return remediation.verify_effective(doc_records(spark, sf), effective(spark, sf), "path", ["class_label", "sha256"])


@query("exclusion_problems", f"""select path, 'no such record' as problem from (select distinct path from {RES} where path is not null) where path not in (select path from {DOCS})
union select r.path, 'class_label' from (select distinct path, source_class_label as l from {RES} where path is not null) r join {DOCS} d on r.path = d.path where r.l is distinct from d.class_label""")
def _(spark, sf):
    e = resolution(spark, sf).where("path is not null").select("path", F.col("source_class_label").alias("class_label")).distinct()
    return remediation.excluded(doc_records(spark, sf), e, "path", ["class_label"])[1]


@query("insert_missing_pairs", f"select id, d from {PA} union all select id, d from (select distinct id, d from {RV}) where id not in (select id from {PA})")
def _(spark, sf):
    claims, known = pair_sides(spark, sf)
    return crosswalk.insert_missing(known.select("id", "d"), claims.select("id", "d").distinct(), ["id"])


@query("merged_decisions", """with f as (select distinct canonical_pair_id as id from leakage_plantvillage_vs_plantdoc_pairs where canonical_pair_id is not null), h as (select canonical_pair_id as id, max(human_decision) as human_decision from cross_dataset_near_duplicate_review where canonical_pair_id is not null group by 1)
select coalesce(f.id, h.id) as id, human_decision, case when f.id is null then 'lost' when h.id is null then 'new' else 'kept' end as outcome from f full join h on f.id = h.id where f.id is not null or coalesce(human_decision, '') <> ''""")
def _(spark, sf):
    f = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").where("canonical_pair_id is not null").select(F.col("canonical_pair_id").alias("id")).distinct()
    h = table(spark, sf, "cross_dataset_near_duplicate_review").where("canonical_pair_id is not null").groupBy(F.col("canonical_pair_id").alias("id")).agg(F.max("human_decision").alias("human_decision"))
    return crosswalk.merge_decisions(f, h, "id", ["human_decision"], "human_decision")


@query("label_changes", f"with o as (select path, min(class_label) as old from {DOCS} group by 1), n as (select path, max(nullif(trim(effective_class_label), '')) as new from {RES} where path is not null group by 1) select coalesce(o.path, n.path) as path, old, new, case when o.path is null then 'added' when n.path is null then 'removed' else 'changed' end as change from o full join n on o.path = n.path where o.path is null or n.path is null or old is distinct from new")
def _(spark, sf):
    old = doc_records(spark, sf).groupBy("path").agg(F.min("class_label").alias("l"))
    new = resolution(spark, sf).where("path is not null").groupBy("path").agg(F.max(F.nullif(F.trim("effective_class_label"), F.lit(""))).alias("l"))
    return crosswalk.changes(old, new, "path", "l")


TR = "(select distinct relpath, class_label, leaf_id from plantvillage where relpath is not null)"


def leaves(spark, sf):
    return table(spark, sf, "plantvillage").where("relpath is not null").select("relpath", "class_label", "leaf_id").distinct()


@query("grouped_split", f"""with k as (select *, case when trim(leaf_id) <> '' then 'g|' || trim(leaf_id) else 'p|' || relpath end as g from {TR}), q as (select g, arg_min(class_label, relpath) as c from k group by 1),
o as (select g, row_number() over (partition by c order by md5('7|' || g), g) as r, count(*) over (partition by c) as n from q)
select relpath, class_label, leaf_id, case when n >= 3 and r <= greatest(1, least(cast(round_even(n * 0.2, 0) as bigint), n - 1)) then 'val' else 'train' end as side from k join o on k.g = o.g""")
def _(spark, sf):
    return splits.grouped_split(leaves(spark, sf), "class_label", "leaf_id", "relpath", 0.2, 7, Scratch(spark))


@query("head_per_class", f"select relpath, class_label from (select *, row_number() over (partition by class_label order by relpath) as n from {TR}) where n <= 3")
def _(spark, sf):
    return splits.head_per_class(leaves(spark, sf).select("relpath", "class_label"), "class_label", "relpath", 3)


@query("cap_per_class", f"select relpath, class_label from (select *, row_number() over (partition by class_label order by md5('5|' || relpath), relpath) as n from {TR}) where n <= 20")
def _(spark, sf):
    return splits.cap_per_class(leaves(spark, sf).select("relpath", "class_label"), "class_label", "relpath", 20, 5)


@query("every_kth_record", f"select relpath from (select relpath, row_number() over (order by relpath) as n from (select distinct relpath from {TR})) where (n - 1) % 97 = 0")
def _(spark, sf):
    return splits.every_kth(leaves(spark, sf).select("relpath").distinct(), "relpath", 97, Scratch(spark))


@query("probe_sample", f"select relpath from (select distinct relpath from {TR}) order by md5('3|' || relpath), relpath limit 100")
def _(spark, sf):
    return splits.probe(leaves(spark, sf).select("relpath").distinct(), "relpath", 100, 3)


@query("share_split", f"select side, count(*) as n from (select case when b < 70 then 'train' when b < 85 then 'val' else 'test' end as side from (select cast('0x' || substr(md5('9|' || coalesce(leaf_id, '')), 1, 8) as bigint) % 100 as b from {TR})) group by 1")
def _(spark, sf):
    return splits.share_split(leaves(spark, sf), "leaf_id", {"train": 70, "val": 15, "test": 15}, 9).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("path_spellings", "select count(*) as n, count(distinct training_relpath) as n_spellings, count(distinct nullif(regexp_replace(regexp_replace(trim(training_relpath), '[/\\\\]+', '/', 'g'), '^(\\./)+', ''), '')) as n_paths from leakage_plantvillage_vs_plantdoc_pairs")
def _(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs")
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("training_relpath").alias("n_spellings"), F.count_distinct(path_form(F.col("training_relpath"))).alias("n_paths"))


@query("event_properties", "select event_type, cast(json_extract_string(props, '$.k') as integer) % 10 as k, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("int") % 10
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
