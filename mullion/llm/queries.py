"""The llm queries p1, p2 and p5 to p8, and the SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions.paths import normal_path
from mullion.functions.records import digest, digest_bytes, phash_bits, split_name
from mullion.llm import components, grouping, overlap, pack, sentences, tokens
from mullion.scale import Scratch


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").select(normal_path(F.col("training_relpath")).alias("a"), normal_path(F.col("evaluation_relpath")).alias("b"))
    members = _table(spark, sf, "plantdoc_internal_duplicate_resolution").select(normal_path(F.col("active_relative_path")).alias("a"), F.nullif(F.trim("group_id"), F.lit("")).alias("b"))
    record, hub = F.lit("record"), F.lit("hub")
    links = pairs.select(record.alias("kind_a"), "a", record.alias("kind_b"), "b").unionAll(members.select(record, "a", hub, "b"))
    # Kept once, so that paths are brought to their form once.
    links = Scratch(spark).keep(links, "named")
    named = links.select(F.explode(F.array("a", F.when(F.col("kind_b") == "record", F.col("b")))).alias("key"))
    groups = components.linked_groups(named.select(record.alias("kind"), "key"), links)
    return groups.select(F.col("group_key").alias("group_path"), F.col("key").alias("record_path"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    both = None
    for name in ("plantvillage", "plantdoc"):
        t = _table(spark, sf, name).select("record_id", "dataset", split_name(F.col("split")).alias("split"), digest(F.col("sha256")).alias("digest"), phash_bits(F.col("phash")).alias("h"))
        both = t if both is None else both.unionAll(t)
    return both.where("split is not null").withColumn("side", F.when(F.col("split") == "train", "train").otherwise("eval"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).select("record_id", "side", digest_bytes(F.col("digest")).alias("digest"), "h")
    return overlap.cross_split_pairs(Scratch(spark).keep(rows.distinct(), "records"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("record_id_a", "record_id_b")


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Near hashes across splits with the numbers of records that hold them, as texts of 16 digits."""
    rows = Scratch(spark).keep(_records(spark, sf).select("record_id", "side", "h").distinct(), "records")
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias(c)
    return overlap.near_classes(rows).select(text("h_train"), text("h_eval"), "distance", "n_train", "n_eval")


def p2_edit_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of hashes of training and evaluation records within two edits, insertions and deletions too."""
    rows = _records(spark, sf).where("h is not null").select("side", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("s")).distinct()
    rows = Scratch(spark).keep(rows, "texts")
    return overlap.edit_segment_join(rows.where("side = 'train'"), rows.where("side = 'eval'"), 2)


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping pairs per evaluation split and dataset of the evaluation record."""
    pairs = _pairs(spark, sf)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("record_id_a").alias("id"), F.col("record_id_b").alias("other")), F.struct(F.col("record_id_b").alias("id"), F.col("record_id_a").alias("other")))).alias("s")).select("s.id", "s.other")
    held = _records(spark, sf).where("side = 'eval'").select(F.col("record_id").alias("id"), "split", "dataset").distinct()
    found = sides.join(held, "id").groupBy("split", "dataset").agg(F.count_distinct("id", "other").alias("n_pairs"), F.count_distinct("id").alias("n_records"))
    return found


def _key_form(c: F.Column) -> F.Column:
    bare = F.trim(F.regexp_replace(F.lower(c), r"[\s 　]+", " "))
    return F.when(bare != "", bare)


def _keyed(spark: SparkSession, sf: str, table: str) -> DataFrame:
    t = _table(spark, sf, table)
    if table == "plantvillage":
        key = _key_form(F.col("leaf_id"))
        return t.select(F.when(key != "-1", key).alias("key"), split_name(F.col("split")).alias("split"), F.col("record_id").cast("string").alias("row_key"))
    return t.select(_key_form(F.col("dataset")).alias("key"), split_name(F.col("split")).alias("split"), F.concat_ws("|", "model", "setting", "seed").alias("row_key"))


KEYED_TABLES = ("plantvillage", "table6_calibration_per_seed")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for table in KEYED_TABLES:
        scratch = Scratch(spark)
        rows = _keyed(spark, sf, table).where("key is not null").select("key", "split").distinct()
        spread = grouping.related_groups(rows, ["key"], scratch).groupBy("group").agg(F.min("key").alias("group_key"), F.count_distinct("split").alias("n"))
        found = spread.where("n > 1").select(F.lit(table).alias("table_name"), "group_key")
        out = found if out is None else out.unionAll(found)
    return out


def p5_assigned(spark: SparkSession, sf: str) -> DataFrame:
    """(table_name, group_id, n_rows, assigned): the split of every group; a row without a key is a group of its own."""
    shares: dict[str, dict[str, float]] = {}
    for r in _table(spark, sf, "split_targets").orderBy("table_name", "split_name").collect():
        shares.setdefault(r.table_name, {})[r.split_name] = r.share
    out = None
    for table in KEYED_TABLES:
        scratch = Scratch(spark)
        # Rows are counted by key first, so that a leaf with a third of all rows is one row in every join.
        own = F.when(F.col("key").isNull(), F.concat(F.lit("row|"), F.coalesce("row_key", F.lit("")))).alias("own")
        counted = _keyed(spark, sf, table).groupBy("key", own).agg(F.count(F.lit(1)).alias("c"))
        rows = grouping.related_groups(scratch.keep(counted, "counted"), ["key"], scratch)
        groups = rows.groupBy(F.coalesce("group", "own").alias("group_id")).agg(F.sum("c").alias("n"))
        done = grouping.assign_splits(scratch.keep(groups, "groups"), shares[table])
        done = done.select(F.lit(table).alias("table_name"), "group_id", F.col("n").alias("n_rows"), "assigned")
        out = done if out is None else out.unionAll(done)
    return out


def p5_balance(spark: SparkSession, sf: str) -> DataFrame:
    """(table_name, n_rows, n_groups, within) of p5_assigned: whether each split is off its share of rows by no more than
    the largest group, which whole groups can't better in general."""
    shares = _table(spark, sf, "split_targets").select("table_name", F.col("split_name").alias("assigned"), "share")
    held = Scratch(spark).keep(p5_assigned(spark, sf), "assigned")
    total = held.groupBy("table_name").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.max("n_rows").alias("largest"))
    rows = held.groupBy("table_name", "assigned").agg(F.sum("n_rows").alias("n"))
    off = shares.join(F.broadcast(total), "table_name").join(rows, ["table_name", "assigned"], "left").select("table_name", "n_rows", "n_groups", (F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("n_rows")) <= F.col("largest")).alias("ok"))
    return off.groupBy("table_name", "n_rows", "n_groups").agg(F.min("ok").alias("within"))


def p5_linked_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of images by leaf and by digest together: each digest with its group's number of digests and of leaves."""
    scratch = Scratch(spark)
    t = _table(spark, sf, "plantvillage")
    leaf = _key_form(F.col("leaf_id"))
    rows = t.select(F.when(leaf != "-1", leaf).alias("leaf"), digest(F.col("sha256")).alias("digest")).where("digest is not null").distinct()
    grouped = scratch.keep(grouping.related_groups(scratch.keep(rows, "keys"), ["leaf", "digest"], scratch), "grouped")
    sizes = grouped.groupBy("group").agg(F.count_distinct("digest").alias("n_digests"), F.count_distinct("leaf").alias("n_leaves"))
    return grouped.select("digest", "group").distinct().join(sizes, "group").select("digest", "n_digests", "n_leaves")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(_table(spark, sf, "documents"), tokens.vocabulary_path())


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each document comes back from its ids; a null text comes back empty."""
    path = tokens.vocabulary_path()
    docs = _table(spark, sf, "documents")
    ids = Scratch(spark).keep(tokens.encode(docs, path), "ids")
    back = tokens.decode(ids, path).withColumnRenamed("text", "back")
    return docs.select("doc_id", "text").join(back, "doc_id", "left").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def _capacities(spark: SparkSession, sf: str) -> dict[int, int]:
    return {r.spec_id: r.capacity for r in _table(spark, sf, "container_specs").orderBy("spec_id").collect()}


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tokens.token_counts(_table(spark, sf, "documents"), tokens.vocabulary_path())
    return pack.pack(sizes, _capacities(spark, sf))


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and the share of space filled, per container specification."""
    specs = _capacities(spark, sf)
    capacity = F.create_map(*[F.lit(x).cast("long") for kv in specs.items() for x in kv])
    fill = _packed(spark, sf).groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return fill.withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_containers") * capacity[F.col("spec_id").cast("long")]), 6))


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per specification: texts placed, texts lost or placed twice, containers over the capacity, and texts split though
    they fit."""
    placed = Scratch(spark).keep(_packed(spark, sf), "placed")
    specs = _table(spark, sf, "container_specs").select("spec_id", "capacity")
    fill = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_over"))
    docs = placed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n")).join(F.broadcast(specs), "spec_id")
    wanted = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity")))
    per = docs.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("parts") != wanted).alias("n_split"))
    return per.join(fill, "spec_id").select("spec_id", "n_docs", "n_over", "n_split")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(_table(spark, sf, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p2_classes": p2_classes,
    "p2_edit_hashes": p2_edit_hashes,
    "p5_found": p5_found,
    "p5_assigned": p5_assigned,
    "p5_balance": p5_balance,
    "p5_linked_groups": p5_linked_groups,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
}

_PATH = r"nullif(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '^[\s\x{{00A0}}\x{{3000}}]+|[\s\x{{00A0}}\x{{3000}}]+$', '', 'g'), '[/\\]+', '/', 'g'), '^(\./)+', ''), '')"
_SPLIT = "case when lower(trim(split)) in ('train', 'val', 'test') then lower(trim(split)) end"
_BARE = "regexp_replace(lower(trim(phash)), '^0x', '')"
_P2 = f"""
r as (select record_id, dataset, {_SPLIT} as split, nullif(lower(trim(sha256)), '') as d,
  case when regexp_full_match({_BARE}, '[0-9a-f]{{16}}') then cast(concat('0x', {_BARE}) as ubigint) end as h
  from (select record_id, dataset, split, sha256, phash from plantvillage union all select record_id, dataset, split, sha256, phash from plantdoc)),
p as (select distinct least(t.record_id, e.record_id) as record_id_a, greatest(t.record_id, e.record_id) as record_id_b from r t, r e
  where t.split = 'train' and e.split in ('val', 'test') and t.record_id <> e.record_id and (t.d = e.d or bit_count(xor(t.h, e.h)) <= 6))"""
SQL = {
    "p1_found": f"""
with recursive l as (select {_PATH.format('training_relpath')} as a, {_PATH.format('evaluation_relpath')} as b from leakage_plantvillage_vs_plantdoc_pairs
  union all select {_PATH.format('active_relative_path')}, chr(1114111) || nullif(trim(group_id), '') from plantdoc_internal_duplicate_resolution),
n as (select a as k from l where a is not null union select b from l where b is not null and b not like chr(1114111) || '%'),
e as (select a, b from l where a is not null and b is not null union select b, a from l where a is not null and b is not null),
r as (select k as s, k as k from n union select r.s, e.b from r join e on r.k = e.a)
select min(k) as group_path, s as record_path from r group by s""",
    "p2_found": f"with {_P2} select * from p",
    "p2_classes": f"""with {_P2.partition("p as (select")[0].rstrip().rstrip(",")},
c as (select split = 'train' as t, h, count(distinct record_id) as n from r where split is not null and h is not null and record_id is not null group by 1, 2)
select printf('%016x', a.h) as h_train, printf('%016x', b.h) as h_eval, cast(bit_count(xor(a.h, b.h)) as int) as distance, a.n as n_train, b.n as n_eval
from c a, c b where a.t and not b.t and bit_count(xor(a.h, b.h)) <= 6""",
    "p2_edit_hashes": f"""with {_P2.partition("p as (select")[0].rstrip().rstrip(",")},
s as (select distinct split = 'train' as t, printf('%016x', h) as s from r where split is not null and h is not null)
select a.s as s_train, b.s as s_eval, cast(levenshtein(a.s, b.s) as int) as distance from s a, s b where a.t and not b.t and levenshtein(a.s, b.s) <= 2""",
    "p2_counts": f"""with {_P2},
s as (select record_id_a as id, record_id_b as other from p union all select record_id_b, record_id_a from p),
h as (select distinct record_id as id, split, dataset from r where split in ('val', 'test'))
select split, dataset, count(distinct (id, other)) as n_pairs, count(distinct id) as n_records from s join h using (id) group by 1, 2""",
    "p5_found": f"""
with k as (select 'plantvillage' as table_name, trim(regexp_replace(lower(leaf_id), '[\\s\\x{{00A0}}\\x{{3000}}]+', ' ', 'g')) as group_key, {_SPLIT} as s from plantvillage
  union all select 'table6_calibration_per_seed', trim(regexp_replace(lower(dataset), '[\\s\\x{{00A0}}\\x{{3000}}]+', ' ', 'g')), {_SPLIT} from table6_calibration_per_seed)
select table_name, group_key from k where group_key <> '' and not (table_name = 'plantvillage' and group_key = '-1') group by 1, 2 having count(distinct s) > 1""",
    "p6_round_trip": "select doc_id, true as same from documents",
    "p7_checks": "select spec_id, (select count(distinct doc_id) from documents) as n_docs, cast(0 as bigint) as n_over, cast(0 as bigint) as n_split from container_specs",
    "p5_balance": """
with k as (select 'plantvillage' as table_name, trim(regexp_replace(lower(leaf_id), '[\\s\\x{00A0}\\x{3000}]+', ' ', 'g')) as k, 'row|' || record_id as own from plantvillage
  union all select 'table6_calibration_per_seed', trim(regexp_replace(lower(dataset), '[\\s\\x{00A0}\\x{3000}]+', ' ', 'g')), 'row|' || concat_ws('|', model, setting, seed) from table6_calibration_per_seed)
select table_name, count(*) as n_rows, count(distinct case when k is null or k = '' or (table_name = 'plantvillage' and k = '-1') then own else 'key|' || k end) as n_groups, true as within from k group by 1""",
    "p5_linked_groups": """
with recursive p as (select distinct case when l = '' or l = '-1' then null else l end as leaf, d as digest from (select trim(regexp_replace(lower(leaf_id), '[\\s\\x{00A0}\\x{3000}]+', ' ', 'g')) as l, nullif(lower(trim(sha256)), '') as d from plantvillage) where d is not null),
b as (select distinct a.leaf as x, c.leaf as y from p a join p c on a.digest = c.digest where a.leaf is not null and c.leaf is not null),
r as (select distinct x, x as y from b union select r.x, b.y from r join b on r.y = b.x),
g as (select x as leaf, min(y) as g from r group by 1),
m as (select digest, coalesce(min(g), '=' || digest) as g from (select p.digest, g.g from p left join g on p.leaf = g.leaf) group by 1),
s as (select m.g, count(distinct m.digest) as n_digests, count(distinct p.leaf) as n_leaves from m join p on p.digest = m.digest group by 1)
select digest, n_digests, n_leaves from m join s using (g)""",
}
