"""Queries on manifests: profiles, duplicate groups, collisions, and searches for near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions.hashes import canonical_id, hamming_hex, joined, set_digest, sign_bits
from mullion.functions.paths import nfc
from mullion.functions.records import digest, phash_bits, split_name
from mullion.functions.text import collision_safe, fold_key, tag_after
from mullion.operators import neardup, profile
from mullion.scale import Scratch, numbered

VALID_PHASH = "regexp_full_match(regexp_replace(lower(trim(phash)), '^0x', ''), '[0-9a-f]{16}')"
H = f"case when {VALID_PHASH} then cast(concat('0x', regexp_replace(lower(trim(phash)), '^0x', '')) as ubigint) end"
SP = "case when lower(trim(split)) in ('train', 'val', 'test') then lower(trim(split)) end"
DIG = "nullif(lower(trim(sha256)), '')"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def manifest(spark: SparkSession, sf: str, name: str = "plantvillage") -> DataFrame:
    """A manifest's rows with split, digest and hash in one notation; repeats are kept once."""
    t = table(spark, sf, name).select("record_id", "dataset", "split", "class_label", "relpath", "sha256", "phash", "width", "height", "mode", "n_bytes", "is_corrupt")
    return t.withColumn("split", split_name(F.col("split"))).withColumn("sha256", digest(F.col("sha256"))).withColumn("h", phash_bits(F.col("phash"))).distinct()


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles to six places, where the two engines' orders of summation can't be told apart."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def man_sql(name: str = "plantvillage") -> str:
    return f"(select distinct record_id, dataset, {SP} as split, class_label, relpath, {DIG} as sha256, phash, width, height, mode, n_bytes, is_corrupt, {H} as h from {name})"


M, D = man_sql(), man_sql("plantdoc")
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("manifest_split_summary", f"select split, count(*) as n, count(distinct class_label) as n_classes, min(class_label) as first_class, max(class_label) as last_class, count(*) filter (where is_corrupt) as n_corrupt from {M} group by split")
def _(spark, sf):
    return profile.split_summary(manifest(spark, sf))


@query("manifest_class_list", f"select split, string_agg(class_label, '|' order by class_label) as classes from (select distinct split, class_label from {M}) where class_label is not null group by split")
def _(spark, sf):
    return profile.class_list(manifest(spark, sf))


@query("manifest_medians", f"select quantile_cont(cast(width as double), 0.5) as median_width, quantile_cont(cast(height as double), 0.5) as median_height, quantile_cont(cast(n_bytes as double), 0.5) as median_n_bytes from {M}")
def _(spark, sf):
    return profile.exact_medians(manifest(spark, sf), ["width", "height", "n_bytes"], Scratch(spark))


@query("manifest_mode_histogram", f"select mode, count(*) as n from {M} group by mode")
def _(spark, sf):
    return profile.counts_by(manifest(spark, sf), "mode")


@query("manifest_split_counts", f"select split, count(*) as n from {M} group by split")
def _(spark, sf):
    return profile.counts_by(manifest(spark, sf), "split")


@query("manifest_class_split", f"select class_label, split, count(*) as n from {M} group by 1, 2")
def _(spark, sf):
    return profile.counts_by(manifest(spark, sf), "class_label", "split")


@query("manifest_filled_splits", f"select s as split, (select count(*) from {D} where split = s) as n from (values ('train'), ('val'), ('test'), ('holdout')) v(s)")
def _(spark, sf):
    return profile.filled_counts(manifest(spark, sf, "plantdoc"), "split", ["train", "val", "test", "holdout"])


GROUPS = f"(select sha256 as digest, count(distinct relpath) as n_members, count(distinct split) as n_splits, count(distinct class_label) as n_classes, min(relpath) as first_path from {D} where sha256 is not null group by 1 having count(distinct relpath) > 1)"


def _groups(spark, sf):
    c = F.col
    return profile.content_groups(manifest(spark, sf, "plantdoc"), c("sha256"), c("split"), c("class_label"), c("relpath"))


@query("duplicate_groups", f"select * from {GROUPS}")
def _(spark, sf):
    return _groups(spark, sf)


@query("duplicate_breakdown", f"""select count(*) as n_groups, cast(coalesce(sum(n_members), 0) as bigint) as n_records, count(*) filter (where n_splits > 1) as cross_split, count(*) filter (where n_classes > 1) as cross_class,
count(*) filter (where n_splits > 1 and n_classes > 1) as both, count(*) filter (where n_splits > 1 and n_classes <= 1) as split_only, count(*) filter (where n_splits <= 1 and n_classes > 1) as class_only,
count(*) filter (where n_splits <= 1 and n_classes <= 1) as neither, coalesce(max(n_members), 0) as largest, cast(coalesce(sum(n_members - 1), 0) as bigint) as surplus from {GROUPS}""")
def _(spark, sf):
    return profile.group_breakdown(_groups(spark, sf))


@query("duplicate_display_ids", f"select digest, 'G' || lpad(cast(row_number() over (order by digest) as varchar), cast(greatest(2, length(cast(row_number() over (order by digest) as varchar))) as integer), '0') as display_id from {GROUPS}")
def _(spark, sf):
    n = F.col("n").cast("string")
    return numbered(_groups(spark, sf).select("digest"), [], ["digest"], Scratch(spark)).select("digest", F.concat(F.lit("G"), F.lpad(n, F.greatest(F.lit(2), F.length(n)), F.lit("0"))).alias("display_id"))


@query("duplicate_member_ids", f"select d.relpath, d.sha256 as digest, row_number() over (partition by d.sha256 order by d.relpath) as member from (select distinct relpath, sha256 from {D}) d join {GROUPS} g on d.sha256 = g.digest")
def _(spark, sf):
    rows = manifest(spark, sf, "plantdoc").select("relpath", F.col("sha256").alias("digest")).distinct().join(_groups(spark, sf).select("digest"), "digest", "left_semi")
    return numbered(rows, ["digest"], ["relpath"], Scratch(spark), "member").select("relpath", "digest", "member")


@query("repeated_paths", "select relpath, count(*) as n from (select distinct * from plantdoc) where relpath is not null group by 1 having count(*) > 1")
def _(spark, sf):
    return profile.repeated(table(spark, sf, "plantdoc").distinct(), F.col("relpath"), "relpath")


@query("casefold_collisions", "select count(*) as n, min(relpath) as first, max(relpath) as last from (select distinct relpath from plantdoc where relpath is not null) group by lower(nfc_normalize(relpath)) having count(*) > 1")
def _(spark, sf):
    return profile.collisions(table(spark, sf, "plantdoc"), "relpath", fold_key(F.col("relpath")))


@query("collision_safe_paths", "select distinct relpath, regexp_replace(relpath, '(\\.[^./]+)?$', '') || '__' || substr(sha256, 1, 12) || regexp_extract(relpath, '(\\.[^./]+)$', 1) as safe_path from plantdoc where length(sha256) >= 12")
def _(spark, sf):
    rows = table(spark, sf, "plantdoc").where(F.length("sha256") >= 12)
    return rows.select("relpath", collision_safe(F.col("relpath"), F.col("sha256")).alias("safe_path")).distinct()


@query("class_imbalance", f"select cast(sum(c) as bigint) as n, count(*) as n_classes, arg_min(class_label, (-c, class_label)) as largest, arg_min(class_label, (c, class_label)) as smallest, round(max(c) / min(c), 6) as ratio from (select class_label, count(*) as c from {M} where class_label is not null group by 1)")
def _(spark, sf):
    return rounded(profile.imbalance(manifest(spark, sf), "class_label"))


@query("class_majority_baseline", f"select arg_min(class_label, (-c, class_label)) as label, round(max(c) / sum(c), 6) as accuracy, round(2 * (max(c) / sum(c)) / ((max(c) / sum(c)) + 1) / count(*), 6) as macro_f1 from (select class_label, count(*) as c from {M} where class_label is not null group by 1)")
def _(spark, sf):
    return rounded(profile.majority_baseline(manifest(spark, sf), "class_label"))


LEAF_OK = "coalesce(trim(leaf_id) not in ('', '-1'), false)"


@query("leaf_coverage", f"select count(*) as n, count(*) filter (where {LEAF_OK}) as n_present, round(count(*) filter (where {LEAF_OK}) / count(*), 4) as share, case when count(*) filter (where {LEAF_OK}) / count(*) >= 0.999 then 'ready' when count(*) filter (where {LEAF_OK}) > 0 then 'partial' else 'none' end as state from plantvillage")
def _(spark, sf):
    return profile.coverage(table(spark, sf, "plantvillage"), ~F.trim("leaf_id").isin("", "-1"))


@query("leaf_tags", "select distinct relpath, trim(case when instr(s, '___') > 0 then substr(s, instr(s, '___') + 3) else '' end) as tag from (select relpath, regexp_replace(regexp_extract(relpath, '[^/]*$', 0), '\\.[^.]*$', '') as s from plantvillage)")
def _(spark, sf):
    return table(spark, sf, "plantvillage").select("relpath", tag_after(F.col("relpath")).alias("tag")).distinct()


@query("digests_complete", "select coalesce(bool_and(coalesce(length(sha256) = 64, false)), false) as holds from plantvillage")
def _(spark, sf):
    return profile.all_hold(table(spark, sf, "plantvillage"), F.length("sha256") == 64)


@query("split_leaks", f"select sha256, count(distinct split) as n_values, count(*) as n from {M} where sha256 is not null group by 1 having count(distinct split) > 1")
def _(spark, sf):
    return profile.spread_groups(manifest(spark, sf), "sha256", "split")


@query("class_index", f"select class_label, cast(row_number() over (order by class_label) - 1 as integer) as idx from (select distinct class_label from {M} where class_label is not null)")
def _(spark, sf):
    return profile.class_index(manifest(spark, sf), "class_label")


@query("class_weights", f"select class_label, n, round(raw / avg(raw) over (), 6) as weight from (select class_label, n, sum(n) over () / (count(*) over () * n) as raw from (select class_label, count(*) as n from {M} where class_label is not null group by 1))")
def _(spark, sf):
    return rounded(profile.class_weights(manifest(spark, sf), "class_label"))


@query("train_only_classes", f"select distinct class_label from {D} where split = 'train' except select class_label from {D} where split in ('val', 'test')")
def _(spark, sf):
    d = manifest(spark, sf, "plantdoc")
    return d.where("split = 'train'").select("class_label").subtract(d.where("split in ('val', 'test')").select("class_label"))


@query("hash_index", f"select distinct record_id, relpath, cast(bit_count(h) as integer) as n_bits, length(cast(h as varchar)) > 0 as hashed from {M} where h is not null and not coalesce(is_corrupt, false)")
def _(spark, sf):
    m = manifest(spark, sf).where("h is not null and not coalesce(is_corrupt, false)")
    return m.select("record_id", "relpath", F.bit_count("h").alias("n_bits"), F.col("h").isNotNull().alias("hashed")).distinct()


@query("hash_index_skipped", f"select distinct record_id, relpath, case when is_corrupt then 'corrupt' else 'no hash' end as reason from {M} where h is null or coalesce(is_corrupt, false)")
def _(spark, sf):
    m = manifest(spark, sf).where("h is null or coalesce(is_corrupt, false)")
    return m.select("record_id", "relpath", F.when(F.coalesce("is_corrupt", F.lit(False)), "corrupt").otherwise("no hash").alias("reason")).distinct()


@query("exact_digest_links", f"select sha256, n_a, n_b from (select sha256, count(distinct record_id) as n_a from {M} where sha256 is not null group by 1) join (select sha256, count(distinct record_id) as n_b from {D} where sha256 is not null group by 1) using (sha256)")
def _(spark, sf):
    a = manifest(spark, sf).select(F.col("record_id").alias("id"), "sha256")
    b = manifest(spark, sf, "plantdoc").select(F.col("record_id").alias("id"), "sha256")
    return neardup.exact_links(a, b, "sha256")


def _ids(spark, sf, name):
    """Records and hashes; the search combines repeats itself."""
    return table(spark, sf, name).select(F.col("record_id").alias("id"), phash_bits(F.col("phash")).alias("h"))


@query("exact_hash_links", f"select cast(h as varchar) as hash, n_a, n_b from (select h, count(distinct record_id) as n_a from {M} where h is not null group by 1) join (select h, count(distinct record_id) as n_b from {D} where h is not null group by 1) using (h)")
def _(spark, sf):
    found = neardup.exact_links(_ids(spark, sf, "plantvillage"), _ids(spark, sf, "plantdoc"))
    unsigned = F.conv(F.hex("h"), 16, 10)
    return found.select(unsigned.alias("hash"), "n_a", "n_b")


@query("near_pairs_cross", f"select a.record_id as id_a, b.record_id as id_b, cast(min(bit_count(xor(a.h, b.h))) as integer) as distance from {M} a, {D} b where bit_count(xor(a.h, b.h)) between 1 and 6 group by 1, 2")
def _(spark, sf):
    return neardup.near_pairs(_ids(spark, sf, "plantvillage"), _ids(spark, sf, "plantdoc"), 6)


@query("near_pairs_cross_banded", f"select a.record_id as id_a, b.record_id as id_b, cast(min(bit_count(xor(a.h, b.h))) as integer) as distance from {M} a, {D} b where bit_count(xor(a.h, b.h)) between 1 and 4 group by 1, 2")
def _(spark, sf):
    return neardup.near_pairs(_ids(spark, sf, "plantvillage"), _ids(spark, sf, "plantdoc"), 4, "banded")


@query("near_pairs_within", f"select least(a.record_id, b.record_id) as id_a, greatest(a.record_id, b.record_id) as id_b, cast(min(bit_count(xor(a.h, b.h))) as integer) as distance from {D} a, {D} b where a.record_id <> b.record_id and bit_count(xor(a.h, b.h)) between 1 and 5 group by 1, 2")
def _(spark, sf):
    return neardup.near_pairs(_ids(spark, sf, "plantdoc"), None, 5)


@query("near_search_telemetry", f"""with a as (select distinct h from {M} where h is not null), b as (select distinct h from {D} where h is not null)
select (select count(h) from {M}) as records_a, (select count(*) from a) as distinct_a, (select count(h) from {D}) as records_b, (select count(*) from b) as distinct_b,
(select count(*) from a, b where bit_count(xor(a.h, b.h)) between 1 and 6) as near_values, (select count(*) from a join b using (h)) as exact_values, (select count(*) from a) * (select count(*) from b) as possible""")
def _(spark, sf):
    a, b = (manifest(spark, sf, n).select(F.col("record_id").alias("id"), "h") for n in ("plantvillage", "plantdoc"))
    return neardup.telemetry(a, b, 6)


@query("two_population_difference", f"select a.record_id as id_a, b.record_id as id_b from {M} a, {D} b where bit_count(xor(a.h, b.h)) between 1 and 6 group by 1, 2 except select a.record_id, b.record_id from {M} a, {D} b where b.split = 'train' and bit_count(xor(a.h, b.h)) between 1 and 6")
def _(spark, sf):
    b = table(spark, sf, "plantdoc").select(F.col("record_id").alias("id"), phash_bits(F.col("phash")).alias("h"), (split_name(F.col("split")) == "train").alias("inside"))
    return neardup.pairs_outside(_ids(spark, sf, "plantvillage"), b, "inside", 6)


@query("near_pairs_training", f"select least(a.record_id, b.record_id) as id_a, greatest(a.record_id, b.record_id) as id_b, cast(min(bit_count(xor(a.h, b.h))) as integer) as distance from {M} a, {M} b where a.record_id < b.record_id and bit_count(xor(a.h, b.h)) between 1 and 3 group by 1, 2")
def _(spark, sf):
    return neardup.near_pairs(_ids(spark, sf, "plantvillage"), None, 3)


@query("near_hash_classes", f"with a as (select h, count(distinct record_id) as n from {M} where h is not null group by 1), b as (select h, count(distinct record_id) as n from {D} where h is not null group by 1) select printf('%016x', a.h) as ha, printf('%016x', b.h) as hb, cast(bit_count(xor(a.h, b.h)) as integer) as distance, a.n as n_a, b.n as n_b from a, b where bit_count(xor(a.h, b.h)) between 1 and 6")
def _(spark, sf):
    found = neardup.near_classes(_ids(spark, sf, "plantvillage"), _ids(spark, sf, "plantdoc"), 6)
    return found.select(*[F.lower(F.lpad(F.hex(c), 16, "0")).alias(c) for c in ("ha", "hb")], "distance", "n_a", "n_b")


@query("near_pairs_wide", f"select a.record_id as id_a, b.record_id as id_b, cast(min(2 * bit_count(xor(a.h, b.h))) as integer) as distance from {M} a, {D} b where bit_count(xor(a.h, b.h)) <= 4 group by 1, 2")
def _(spark, sf):
    """Hashes of 128 bits, made of a hash and its complement, so that distances are twice as large."""
    wide = lambda n: _ids(spark, sf, n).select("id", F.when(F.col("h").isNotNull(), F.array("h", F.bitwise_not("h"))).alias("h"))
    return neardup.near_wide(wide("plantvillage"), wide("plantdoc"), 8, 128)


@query("malformed_hashes", "select t as table_name, count(*) as n from (select 'plantvillage' as t, phash from plantvillage union all select 'plantdoc', phash from plantdoc) where phash is not null and not regexp_full_match(regexp_replace(lower(trim(phash)), '^0x', ''), '[0-9a-f]{16}') group by 1")
def _(spark, sf):
    out = None
    for name in ("plantvillage", "plantdoc"):
        t = neardup.malformed(table(spark, sf, name), "phash").groupBy(F.lit(name).alias("table_name")).agg(F.count(F.lit(1)).alias("n"))
        out = t if out is None else out.unionAll(t)
    return out


BITS = "(select vec_id, " + " || ".join(f"case when embedding[{i + 1}] > 0 then '1' else '0' end" for i in range(64)) + " as b from embeddings)"


@query("embedding_sign_pairs", f"select a.vec_id as id_a, b.vec_id as id_b, cast(bit_count(xor(a.b::bit, b.b::bit)) as integer) as distance from {BITS} a join {BITS} b on a.vec_id < b.vec_id where bit_count(xor(a.b::bit, b.b::bit)) between 1 and 20")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), sign_bits(F.col("embedding"), 64).alias("h"))
    return neardup.near_pairs(rows, None, 20, "broad")


@query("document_content_groups", "select sha256(text) as digest, count(*) as n, count(distinct source) as n_sources, count(distinct lang) as n_langs from documents where text is not null group by 1 having count(*) > 1")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs")).where("n > 1")


@query("stated_distances", "select pair_row_id, hamming_distance as stated, cast(bit_count(xor(cast(concat('0x', regexp_replace(lower(trim(training_phash)), '^0x', '')) as ubigint), cast(concat('0x', regexp_replace(lower(trim(evaluation_phash)), '^0x', '')) as ubigint))) as integer) as computed from (select distinct * from leakage_plantvillage_vs_plantdoc_pairs) where regexp_full_match(regexp_replace(lower(trim(training_phash)), '^0x', ''), '[0-9a-f]{16}') and regexp_full_match(regexp_replace(lower(trim(evaluation_phash)), '^0x', ''), '[0-9a-f]{16}')")
def _(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").distinct()
    t, e = (F.regexp_replace(F.lower(F.trim(c)), "^0x", "") for c in ("training_phash", "evaluation_phash"))
    sound = p.where(t.rlike("^[0-9a-f]{16}$") & e.rlike("^[0-9a-f]{16}$"))
    return sound.select("pair_row_id", F.col("hamming_distance").alias("stated"), hamming_hex(t, e).alias("computed"))


_JSON = r"""replace(replace(coalesce({0}, ''), '\', '\\'), '"', '\"')"""
CANON = f"""'near-' || substr(sha256('{{"evaluation_relpath":"' || {_JSON.format('evaluation_relpath')} || '","hash_bits":64,"pair_type":"near","training_relpath":"' || {_JSON.format('training_relpath')} || '"}}'), 1, 16)"""


@query("canonical_pair_ids", f"select pair_row_id, {CANON} as pair_id from (select distinct pair_row_id, training_relpath, evaluation_relpath from leakage_plantvillage_vs_plantdoc_pairs)")
def _(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").select("pair_row_id", "training_relpath", "evaluation_relpath").distinct()
    made = canonical_id("near", {"training_relpath": F.col("training_relpath"), "evaluation_relpath": F.col("evaluation_relpath"), "pair_type": F.lit("near")}, {"hash_bits": F.lit(64)})
    return p.select("pair_row_id", made.alias("pair_id"))


@query("pair_display_ids", "select pair_row_id, 'ndp-' || lpad(cast(n as varchar), cast(greatest(2, length(cast(n as varchar))) as integer), '0') as display_id from (select pair_row_id, row_number() over (partition by classification order by hamming_distance nulls first, training_relpath nulls first, evaluation_relpath nulls first, pair_row_id) as n from (select distinct pair_row_id, classification, hamming_distance, training_relpath, evaluation_relpath from leakage_plantvillage_vs_plantdoc_pairs))")
def _(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").select("pair_row_id", "classification", "hamming_distance", "training_relpath", "evaluation_relpath").distinct()
    n = F.col("n").cast("string")
    p = numbered(p, ["classification"], ["hamming_distance", "training_relpath", "evaluation_relpath", "pair_row_id"], Scratch(spark))
    return p.select("pair_row_id", F.concat(F.lit("ndp-"), F.lpad(n, F.greatest(F.lit(2), F.length(n)), F.lit("0"))).alias("display_id"))


@query("manifest_set_digest", f"""select cast(sum(n) as bigint) as n, sha256(string_agg(d, chr(10) order by b)) as digest from (
select substr(c, 1, 2) as b, sum(n) as n, sha256(string_agg(d, chr(10) order by c)) as d from (
select substr(h, 1, 4) as c, sum(k) as n, sha256(string_agg(h, chr(10) order by h)) as d from (select sha256(i || ':' || count(*)) as h, count(*) as k from (select sha256(concat_ws(chr(9), coalesce(relpath, ''), coalesce(split, ''), coalesce(class_label, ''), coalesce(sha256, ''))) as i from {M}) group by i) group by 1) group by 1)""")
def _(spark, sf):
    return set_digest(manifest(spark, sf), joined(["relpath", "split", "class_label", "sha256"]))


@query("hash_prefixes", f"select lower(substr(regexp_replace(lower(trim(phash)), '^0x', ''), 1, 1)) as prefix, count(*) as n from {M} where h is not null group by 1")
def _(spark, sf):
    m = manifest(spark, sf).where("h is not null")
    return m.groupBy(F.lower(F.substring(F.lpad(F.hex("h"), 16, "0"), 1, 1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("composed_paths", "select field, count(*) as n, count(*) filter (where nfc_normalize(p) <> p) as n_decomposed from (select 'training_relpath' as field, training_relpath as p from leakage_plantvillage_vs_plantdoc_pairs union all select 'evaluation_relpath', evaluation_relpath from leakage_plantvillage_vs_plantdoc_pairs) group by 1")
def _(spark, sf):
    p = table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs")
    rows = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("p")) for c in ("training_relpath", "evaluation_relpath")])).alias("r")).select("r.*")
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(nfc(F.col("p")) != F.col("p")).alias("n_decomposed"))

