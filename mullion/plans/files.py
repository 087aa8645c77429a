"""Queries that write tables, documents and images to the shared folder and read them back with the readers.

The SQL states what has to come back. Pictures are drawn of the nations, one flat colour each, so that SQL can say what
their digests, histograms and likenesses are.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions.hashes import hamming_words, hash_words
from mullion.functions.text import grouped_digits, p_text, typeset, typeset_row, utc_now
from mullion.operators import calibration, inference, locks, metrics, reconcile
from mullion.plans.evaluation import PROBS, R, predictions, runs_of
from mullion.plans.manifests import rounded, table
from mullion.scale import Scratch
from mullion.sources import fetch, images, scans, sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


REBUILT = ("relpath", "dataset", "split", "class_label", "sha256", "width", "height", "mode", "n_bytes", "is_corrupt", "source_url", "acquired_at_utc", "leaf_id", "has_leaf_id")


@query("csv_texts", "select '' as note, " + ", ".join(f"coalesce({c}, '') as {c}" for c in REBUILT) + " from plantvillage_rebuilt")
def _(spark, sf):
    path = sinks.write_table(table(spark, sf, "plantvillage_rebuilt").select(*REBUILT), f"{Scratch(spark).root}/texts", "csv")
    return scans.read_strings(spark, path, ["note", "relpath"])


@query("csv_manifest", "select dataset, split, class_label, relpath, sha256, width, height, mode, n_bytes, is_corrupt, source_url, acquired_us from (select coalesce(dataset, '') as dataset, coalesce(split, '') as split, coalesce(class_label, '') as class_label, coalesce(relpath, '') as relpath, coalesce(sha256, '') as sha256, width, height, coalesce(mode, '') as mode, n_bytes, is_corrupt, coalesce(source_url, '') as source_url, epoch_us(acquired_at_utc) as acquired_us from plantvillage)")
def _(spark, sf):
    names = [f.name for f in scans.MANIFEST.fields]
    m = table(spark, sf, "plantvillage").select(*[F.col(c).cast("string").alias(c) for c in names])
    back = scans.read_manifest(spark, sinks.write_table(m, f"{Scratch(spark).root}/manifest", "csv"))
    return back.withColumn("acquired_us", F.unix_micros("acquired_at_utc")).drop("acquired_at_utc")


@query("table_formats", "select kind, review_row_id, human_decision, reviewer from (values ('parquet'), ('orc'), ('json')) k(kind), cross_dataset_near_duplicate_review")
def _(spark, sf):
    rows, root, out = table(spark, sf, "cross_dataset_near_duplicate_review").select("review_row_id", "human_decision", "reviewer"), Scratch(spark).root, None
    for kind in ("parquet", "orc", "json"):
        path = sinks.write_table(rows.withColumn("part", F.pmod("review_row_id", F.lit(3))), f"{root}/{kind}", kind, ["part"])
        back = spark.read.schema("review_row_id long, human_decision string, reviewer string").format(kind).load(path).select(F.lit(kind).alias("kind"), "review_row_id", "human_decision", "reviewer")
        out = back if out is None else out.unionByName(back)
    return out


@query("nested_results", "select coalesce(model, '-') as model, dataset, seed, round(ece, 9) as ece from table6_calibration_per_seed where model is not null and ece is not null and not isnan(ece)")
def _(spark, sf):
    """One JSON document per model (models are few), read and unnested again."""
    rows = table(spark, sf, "table6_calibration_per_seed").where("model is not null and ece is not null and not isnan(ece)")
    docs = rows.groupBy("model").agg(F.collect_list(F.struct("dataset", "seed", "ece")).alias("history"))
    texts = docs.select(F.to_json(F.struct("model", "history")).alias("value"), F.xxhash64("model").alias("part"))
    path = f"{Scratch(spark).root}/runs"
    texts.repartition("part").write.partitionBy("part").text(path)
    back = scans.read_nested(spark, path, "model string, history array<struct<dataset: string, seed: long, ece: double>>")
    return rounded(back.select("model", F.explode("history").alias("h")).select("model", "h.dataset", "h.seed", "h.ece"), 9)


@query("score_archives", f"select cast(item as bigint) as item_id, cast(y as integer) as y_true, a, b from (select n_nationkey as item, n_regionkey % 2 as y, n_nationkey / cast(4 as double) as a, cast(n_regionkey as double) as b from nation)")
def _(spark, sf):
    rows = table(spark, sf, "nation").orderBy("n_nationkey").limit(1000).select("n_nationkey", "n_regionkey").collect()
    held = io.BytesIO()
    np.savez(held, labels=np.array([r.n_regionkey % 2 for r in rows]), logits=np.array([[r.n_nationkey / 4, r.n_regionkey] for r in rows]))
    root = Scratch(spark).root
    sinks.write_bytes(spark, f"{root}/scores/run.npz", held.getvalue())
    got = scans.read_scores(spark, f"{root}/scores")
    return got.select("item_id", "y_true", F.col("scores")[0].alias("a"), F.col("scores")[1].alias("b"))


@query("text_file_digests", "select 'n' || n_nationkey || '.txt' as relpath, cast(length(n_name) + 1 as bigint) as n_bytes, sha256(n_name || chr(10)) as sha256 from nation")
def _(spark, sf):
    root = Scratch(spark).root
    for r in _nations(spark, sf):
        sinks.write_bytes(spark, f"{root}/texts/n{r.n_nationkey}.txt", f"{r.n_name}\n".encode())
    return scans.file_digests(spark, f"{root}/texts", "*.txt")


@query("changed_files", "select 'n' || n_nationkey || '.txt' as relpath, case n_nationkey % 3 when 0 then 'absent' else 'changed' end as problem from nation where n_nationkey % 3 < 2")
def _(spark, sf):
    """Files bound by digest, of which every third is gone and every third another."""
    root, nations = Scratch(spark).root, _nations(spark, sf)
    for r in nations:
        if r.n_nationkey % 3:
            sinks.write_bytes(spark, f"{root}/files/n{r.n_nationkey}.txt", (r.n_name + "!" * (r.n_nationkey % 3 == 1)).encode())
    bound = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".txt")).alias("relpath"), F.sha2("n_name", 256).alias("sha256"))
    return scans.digest_breaks(scans.file_digests(spark, f"{root}/files"), bound)


@query("listing_counts", "select case when n_nationkey % 2 = 0 then 'train' else 'test' end as split, 'r' || n_regionkey as class_label, count(*) as n from nation group by 1, 2")
def _(spark, sf):
    path = f"{Scratch(spark).root}/listing"
    n = table(spark, sf, "nation")
    lines = n.select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "train").otherwise("test"), F.lit("/r"), "n_regionkey", F.lit("/"), "n_name", F.lit(".jpg")).alias("value"))
    lines.unionAll(spark.createDataFrame([("",), ("readme.md",)], "value string")).write.text(path)
    return scans.listing_classes(scans.read_lines(spark, path))


@query("cost_settings", "select a.n as true_action, b.n as pred_action, cast(case when a.i = b.i then 0 else a.i * 2 + b.i + 1 end as double) as cost from (values (0, 'keep'), (1, 'drop'), (2, 'ask')) a(i, n), (values (0, 'keep'), (1, 'drop'), (2, 'ask')) b(i, n)")
def _(spark, sf):
    names = ("keep", "drop", "ask")
    path = sinks.write_json({"weights": {a: {b: 0 if a == b else i * 2 + j + 1 for j, b in enumerate(names)} for i, a in enumerate(names)}}, f"{_local(spark)}/costs.json")
    return scans.cost_rows(spark, scans.read_settings(path)["weights"])


@query("scope_settings", "select r_name as name, r_regionkey % 2 = 0 as counted from region")
def _(spark, sf):
    entries = [{"name": r.r_name, "counted": r.r_regionkey % 2 == 0} for r in table(spark, sf, "region").limit(1000).collect()]
    path = sinks.write_json({"entries": entries}, f"{_local(spark)}/scope.json")
    return scans.scope_rows(spark, scans.read_settings(path)["entries"], ["name"], ["counted"])


@query("setting_changes", "select * from (values ('batch.size', 'changed', '32', '64'), ('model', 'added', null, '\"b\"'), ('rate', 'removed', '0.1', null)) v(key, outcome, source, derived)")
def _(spark, sf):
    found = scans.settings_differences({"seed": 1, "out": {"dir": "a"}, "batch": {"size": 32}, "rate": 0.1}, {"seed": 2, "out": {"dir": "b"}, "batch": {"size": 64}, "model": "b"}, ["seed", "out"])
    return spark.createDataFrame(found, "key string, outcome string, source string, derived string")


@query("small_csv", "select cast(r_regionkey as varchar) as r_regionkey, r_name from region")
def _(spark, sf):
    path = sinks.write_small_csv(table(spark, sf, "region"), f"{_local(spark)}/region.csv", ["r_regionkey", "r_name"], ["r_regionkey"])
    return scans.read_strings(spark, f"file://{path}")


FACTS = """'{"facts":{"regions":{"n":' || (select count(*) from region) || '}},"inputs":{}}'"""


@query("corpus_lock", f"select sha256({FACTS}) as lock_digest, false as broken, true as found_change")
def _(spark, sf):
    """A lock written and read back holds against itself, and against no other facts."""
    facts = {"regions": table(spark, sf, "region").agg(F.count(F.lit(1)).alias("n"))}
    lock = locks.build_lock(facts)
    held = sinks.read_json(sinks.write_json(lock, f"{_local(spark)}/lock.json"), ["facts", "inputs", "lock_digest"])
    other = locks.build_lock({"regions": facts["regions"].select((F.col("n") + 1).alias("n"))})
    locks.require_lock(held, locks.build_lock(facts), ["regions"])
    return spark.createDataFrame([(held["lock_digest"], bool(locks.lock_problems(held, lock)), locks.lock_problems(held, other) == ["facts.regions"])], "lock_digest string, broken boolean, found_change boolean")


@query("bound_gate", """with c as (select count(*) as p from cross_dataset_near_duplicate_review where human_decision is null or trim(human_decision) = ''), s as (select cast(1 as bigint) as n_checks, p as n_problems from c)
select x.input, n_checks, cast(n_problems as bigint) as n_problems, cast(case when x.input = 'same' then 0 else 1 end as bigint) as n_changes, case when x.input <> 'same' then 'stale' when n_problems > 0 then 'fail' else 'pass' end as status from s, (values ('same'), ('changed'), ('absent')) x(input)""")
def _(spark, sf):
    """One gate over undecided reviews, with its input as bound, changed, and gone."""
    root = Scratch(spark).root
    checks = table(spark, sf, "cross_dataset_near_duplicate_review").agg(F.count_if(F.col("human_decision").isNull() | (F.trim("human_decision") == "")).alias("n_problems")).select(F.lit("undecided").alias("check"), "n_problems")
    for name, text in (("same", b"a"), ("changed", b"b")):
        sinks.write_bytes(spark, f"{root}/in/{name}.txt", text)
    bound = spark.sql("select 'list' as name, sha2('a', 256) as sha256")
    out = None
    for name in ("same", "changed", "absent"):
        g = locks.bound_gate(checks, bound, locks.input_digests(spark, {"list": f"{root}/in/{name}.txt"})).select(F.lit(name).alias("input"), "*")
        out = g if out is None else out.unionAll(g)
    return out


@query("guarded_evaluation", "select 'open' as gate, count(*) as n from lineitem union all select 'refused', null")
def _(spark, sf):
    """An evaluation behind a passed gate runs; behind a failed one it is refused before anything is read."""
    gate = lambda status: spark.createDataFrame([(status,)], "status string")
    done = locks.guarded(gate("pass"), lambda: predictions(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(F.lit("open").alias("gate"), "n"))
    try:
        locks.guarded(gate("stale"), lambda: predictions(spark, sf))
    except PermissionError:
        return done.unionAll(spark.createDataFrame([("refused", None)], "gate string, n long"))
    raise AssertionError("a stale gate let an evaluation pass")


@query("formatted_numbers", "select p_partkey, format('{:,}', cast(p_partkey * 37 as bigint)) as grouped, case when 1 / cast(k * k as double) < 0.0001 then '<0.0001' else printf('%.4f', 1 / cast(k * k as double)) end as p from (select p_partkey, p_partkey + 1 as k from part)")
def _(spark, sf):
    k = F.col("p_partkey") + 1
    return table(spark, sf, "part").select("p_partkey", grouped_digits(F.col("p_partkey") * 37).alias("grouped"), p_text(1.0 / (k * k)).alias("p"))


_FOUR = " + ".join(f"cast(bit_count(xor(cast('0x' || substr(lower(byte_sha256), {i}, 16) as ubigint), cast('0x' || substr(lower(decoded_rgb_sha256), {i}, 16) as ubigint))) as integer)" for i in (1, 17, 33, 49))
_WIDE = "regexp_full_match(lower(byte_sha256), '[0-9a-f]{64}') and regexp_full_match(lower(decoded_rgb_sha256), '[0-9a-f]{64}')"


@query("wide_distances", f"select group_id, member_id, active_relative_path, 4 as words, cast({_FOUR} as integer) as distance from plantdoc_internal_duplicate_resolution where {_WIDE}")
def _(spark, sf):
    """Distances of hashes of 256 bits, as arrays of four words."""
    words = lambda c: F.array(*[F.conv(F.substring(F.lower(c), i, 16), 16, -10).cast("long") for i in (1, 17, 33, 49)])
    sound = table(spark, sf, "plantdoc_internal_duplicate_resolution").where(F.lower("byte_sha256").rlike("^[0-9a-f]{64}$") & F.lower("decoded_rgb_sha256").rlike("^[0-9a-f]{64}$"))
    return sound.select("group_id", "member_id", "active_relative_path", F.lit(hash_words(256)).alias("words"), hamming_words(words("byte_sha256"), words("decoded_rgb_sha256")).alias("distance"))


def _local(spark: SparkSession) -> str:
    """The shared folder as a path of this machine's file system, for documents that the driver alone writes."""
    root = Scratch(spark).root.removeprefix("file://").removeprefix("file:")
    if "://" in root or root.startswith("hdfs:"):
        raise ValueError("single documents are written to a mounted folder only")
    return root


def _nations(spark: SparkSession, sf: str) -> list:
    """Nations are a fixed dimension of 25 rows; more than 1,000 would be no such table and raise."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("the table of nations has more than 1,000 rows")
    return rows


def _drawn(spark: SparkSession, sf: str) -> str:
    """A folder of one flat picture per nation, and masks whose first columns are marked."""
    root = Scratch(spark).root
    for r in _nations(spark, sf):
        n = r.n_nationkey
        w, h = 40 + n, 40
        pixels = np.full((h, w, 3), (n * 5, n * 3, 20 + r.n_regionkey * 20), np.uint8)
        sinks.write_bytes(spark, f"{root}/images/{'train' if n % 2 == 0 else 'test'}/r{r.n_regionkey}/n{n}.png", sinks.png(pixels))
        # Dark on the left, bright on the right; the mask marks a part of the dark side.
        scene, mask = np.full((h, w), 230, np.uint8), np.zeros((h, w), np.uint8)
        scene[:, :20], mask[:, : n % 20 + 1] = 30, 255
        sinks.write_bytes(spark, f"{root}/scenes/n{n}.png", sinks.png(np.stack([scene] * 3, -1)))
        sinks.write_bytes(spark, f"{root}/masks/n{n}.png", sinks.png(mask))
    return root


_WHERE = "(case when n_nationkey % 2 = 0 then 'train' else 'test' end || '/r' || n_regionkey || '/n' || n_nationkey || '.png')"
_RGB = "repeat(chr(cast(n_nationkey * 5 as integer)) || chr(cast(n_nationkey * 3 as integer)) || chr(cast(20 + n_regionkey * 20 as integer)), cast((40 + n_nationkey) * 40 as integer))"


@query("image_manifest", f"select 'drawn' as dataset, split_part({_WHERE}, '/', 1) as split, 'r' || n_regionkey as class_label, {_WHERE} as relpath, cast(40 + n_nationkey as integer) as width, 40 as height, 'RGB' as mode, false as is_corrupt from nation")
def _(spark, sf):
    m = scans.scan_images(spark, f"{_drawn(spark, sf)}/images", "drawn", "")
    return m.select("dataset", "split", "class_label", "relpath", "width", "height", "mode", "is_corrupt")


@query("image_digests", f"select {_WHERE} as relpath, case when n_nationkey > 0 then sha256({_RGB}) end as rgb_sha256, length(cast(n_nationkey as varchar)) * 0 + 16 as phash_digits from nation where n_nationkey > 0")
def _(spark, sf):
    """Digests of decoded pixels; the picture of nation 0 has zero bytes, which SQL texts can't hold."""
    m = images.image_measures(spark, f"{_drawn(spark, sf)}/images").where(~F.col("relpath").endswith("/n0.png"))
    return m.select("relpath", "rgb_sha256", F.length("phash").cast("long").alias("phash_digits"))


@query("hash_index_reused", f"select {_WHERE} as relpath, cast(40 + n_nationkey as integer) as width from nation")
def _(spark, sf):
    """A hash index persisted once and loaded after; the second build would fail if it ran."""
    root = _drawn(spark, sf)

    def never():
        raise AssertionError("built twice")

    scans.load_or_build(spark, f"{root}/index", lambda: images.hash_images(spark, f"{root}/images"), F.col("phash").isNotNull())
    return scans.load_or_build(spark, f"{root}/index", never).select("relpath", "width")


@query("image_likeness", f"""with n as (select *, {_WHERE} as p, (40 + n_nationkey) / cast(40 as double) as ar from nation),
d as (select a.p as a, b.p as b, (abs(a.n_nationkey - b.n_nationkey) * 8 + abs(a.n_regionkey - b.n_regionkey) * 20) / cast(3 as double) as x, abs(a.ar - b.ar) < 0.15 as aspect_close from n a, n b where a.n_nationkey < b.n_nationkey)
select a, b, round(x, 6) as difference, aspect_close, case when x > 60 then 'low' when x > 30 then 'moderate' else 'high' end as similarity from d""")
def _(spark, sf):
    m = Scratch(spark).keep(images.image_measures(spark, f"{_drawn(spark, sf)}/images"), "measures")
    n = table(spark, sf, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "train").otherwise("test"), F.lit("/r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit(".png")).alias("p"), F.col("n_nationkey").alias("k"))
    # All pairs of a fixed dimension of 25 rows, by an equal key; never of a table that grows.
    x, y = n.select(F.col("p").alias("a"), F.col("k").alias("i"), F.lit(1).alias("one")), n.select(F.col("p").alias("b"), F.col("k").alias("j"), F.lit(1).alias("one"))
    return rounded(images.likeness(x.join(y, "one").where("i < j").select("a", "b"), m))


@query("image_histograms", f"select {_WHERE} as relpath, cast(bin as integer) as bin, channel from (select *, unnest([0, 1, 2]) as channel, unnest([n_nationkey * 5 // 16, n_nationkey * 3 // 16, (20 + n_regionkey * 20) // 16]) as bin from nation)")
def _(spark, sf):
    """Bins that hold all pixels of a channel."""
    m = images.image_measures(spark, f"{_drawn(spark, sf)}/images").select("relpath", F.posexplode("histogram").alias("at", "share")).where("share = 1.0")
    return m.select("relpath", (F.col("at") % images.BINS).alias("bin"), F.floor(F.col("at") / images.BINS).cast("int").alias("channel"))


@query("mask_shares", "select 'n' || n_nationkey as stem, round((n_nationkey % 20 + 1) / cast(20 as double), 6) as share from nation")
def _(spark, sf):
    root = _drawn(spark, sf)
    return rounded(images.mask_shares(spark, f"{root}/scenes", f"{root}/masks"))


GRID = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0]
_LOSS = f"(select t, avg(ln(list_sum([exp((x - list_max(logits)) / t) for x in logits])) - (logits[y_true + 1] - list_max(logits)) / t) as loss from {PROBS}, (select unnest({GRID}) as t) group by 1)"


@query("temperature_grid", f"select cast(t as double) as temperature, round(loss, 6) as loss, loss = (select min(loss) from {_LOSS}) as best from {_LOSS}")
def _(spark, sf):
    """Mean loss at fixed temperatures, one pass for all; fit_temperature narrows such grids."""
    losses = calibration.temperature_losses(predictions(spark, sf), GRID)
    best = min(x for _, x in losses)
    return spark.createDataFrame([(t, round(x, 6), x == best) for t, x in losses], "temperature double, loss double, best boolean")


@query("temperature_bracket", f"select count(*) as n_fits, true as within from (values (1)) v(x)")
def _(spark, sf):
    """The fitted temperature lies between the grid's neighbours of the best point: its loss is no worse."""
    rows = Scratch(spark).keep(predictions(spark, sf).select("y_true", "logits"), "logits")
    t = calibration.fit_temperature(rows)
    losses = calibration.temperature_losses(rows, [t, *GRID])
    return spark.createDataFrame([(1, losses[0][1] <= min(x for _, x in losses[1:]) + 1e-9)], "n_fits long, within boolean")


@query("bca_checks", f"select run, 'accuracy' as statistic, round(avg(cast(correct as integer)), 6) as estimate, true as ordered, 'bca' as method from {R} group by 1")
def _(spark, sf):
    """Estimates of the bootstrap's intervals, and whether each lies within its own."""
    b = inference.bca_intervals(metrics.confusion(runs_of(spark, sf), ["run"]), ["run"], 5).where("statistic = 'accuracy'")
    return rounded(b.select("run", "statistic", "estimate", ((F.col("low") <= F.col("estimate")) & (F.col("estimate") <= F.col("high")) & (F.col("low") < F.col("high"))).alias("ordered"), "method"))


@query("fetched_files", "select 'n' || n_nationkey || '.txt' as relpath, case when n_nationkey % 5 = 0 then 'kept' when n_nationkey % 5 = 1 then 'resumed' when n_nationkey % 5 = 2 then 'failed' when n_nationkey % 5 = 3 then 'mismatch' else 'fetched' end as outcome from nation")
def _(spark, sf):
    """Files fetched from a folder's addresses: some there already, some broken off, some gone, some with another digest."""
    root = _local(spark)
    for r in _nations(spark, sf):
        name, k = f"n{r.n_nationkey}.txt", r.n_nationkey % 5
        if k != 2:
            sinks.write_bytes(spark, f"file://{root}/from/{name}", r.n_name.encode())
        if k < 2:
            sinks.write_bytes(spark, f"file://{root}/to/{name}" + ".part" * k, r.n_name.encode()[: None if k == 0 else 3])
    n = table(spark, sf, "nation")
    rel = F.concat(F.lit("n"), "n_nationkey", F.lit(".txt"))
    wanted = n.select(F.concat(F.lit(f"file://{root}/from/"), rel).alias("url"), rel.alias("relpath"), F.sha2(F.when(F.col("n_nationkey") % 5 == 3, "other").otherwise(F.col("n_name")), 256).alias("sha256"))
    return Scratch(spark).keep(fetch.fetch_files(wanted, f"{root}/to", retries=2, backoff=0.0), "fetched")


_TEX = "array_to_string([case c when '\\' then '\\textbackslash{{}}' when '~' then '\\textasciitilde{{}}' when '^' then '\\textasciicircum{{}}' when '&' then '\\&' when '%' then '\\%' when '$' then '\\$' when '#' then '\\#' when '_' then '\\_' when '{{' then '\\{{' when '}}' then '\\}}' else c end for c in string_split({0}, '')], '')"


@query("typeset_paths", f"select pair_row_id, {_TEX.format('training_relpath')} as text from leakage_plantvillage_vs_plantdoc_pairs")
def _(spark, sf):
    return table(spark, sf, "leakage_plantvillage_vs_plantdoc_pairs").select("pair_row_id", typeset(F.col("training_relpath")).alias("text"))


@query("typeset_rows", f"select {_TEX.format('p_name')} || ' & ' || {_TEX.format('p_brand')} || ' & ' || p_size || ' \\\\' as line from part")
def _(spark, sf):
    return table(spark, sf, "part").select(typeset_row([F.col("p_name"), F.col("p_brand"), F.col("p_size")]).alias("line"))


@query("clock_form", "select 20 as digits, true as whole")
def _(spark, sf):
    """The form of the present instant; its value is in no result."""
    now = utc_now()
    return spark.range(1).select(F.length(now).alias("digits"), now.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("whole"))


@query("packet_differences", """select g, p, case when k % 7 = 0 then 'missing' else 'changed' end as outcome, case when k % 7 = 0 then null else 'name' end as field_name from (select n_regionkey as g, n_nationkey as p, n_nationkey as k from nation) where k % 7 = 0 or k % 5 = 1
union all select n_regionkey, n_nationkey + 1000, 'extra', null from nation where n_nationkey % 11 = 3""")
def _(spark, sf):
    """A packet with places left out, added and changed, against what is expected (planted)."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("p"), F.col("n_name").alias("name"), "n_regionkey")
    packet = n.where("p % 7 <> 0").withColumn("name", F.when(F.col("p") % 5 == 1, F.lower("name")).otherwise(F.col("name")))
    packet = packet.unionAll(n.where("p % 11 = 3").withColumn("p", F.col("p") + 1000))
    return reconcile.position_differences(n, packet, "g", "p", ["name", "n_regionkey"])


WEIGHTS, BIAS = [[((7 * k + 3 * i) % 11 - 5) / 8 for i in range(64)] for k in range(3)], [0.5, 0.0, -0.25]
_DOT = "[" + ", ".join(f"{b} + list_sum([cast(embedding[i] as double) * {w}[i] for i in range(1, 65)])" for w, b in zip(WEIGHTS, BIAS)) + "]"


@query("linear_scores", f"select vec_id, round(s[1], 6) as a, round(s[2], 6) as b, round(s[3], 6) as c, cast(list_position(s, list_max(s)) - 1 as integer) as best from (select vec_id, {_DOT} as s from embeddings where len(embedding) = 64)")
def _(spark, sf):
    """Logits of a stored linear model over all vectors, in the plan."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    s = table(spark, sf, "embeddings").where(F.size("embedding") == 64).select("vec_id", metrics.linear_logits(values, WEIGHTS, BIAS).alias("s"))
    return rounded(s.select("vec_id", *[F.col("s")[i].alias(n) for i, n in enumerate("abc")], metrics.first_best(F.col("s")).alias("best")))
