"""Operators on small tables with known answers, nulls, ties, repeats, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from mullion.functions import hashes, paths, records, text
from mullion.operators import calibration, crosswalk, inference, metrics, neardup, profile, reconcile, references, remediation, rules, splits
from mullion.scale import Scratch, numbered, ranked, running_sums


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_paths(spark):
    df = spark.createDataFrame([("./a\\b//c ",), ("././x/y",), ("",), (None,), ("  ",), ("A/é",), (" a/b",)], "p string")
    assert [r[0] for r in df.select(paths.normal_path(F.col("p"))).collect()] == ["a/b/c", "x/y", None, None, None, "A/é", "a/b"]


def test_record_readings(spark):
    df = spark.createDataFrame([(" 0xFFFFFFFFFFFFFFFF", "2026-01-01 02:00:00+02:00", " TRAIN"), ("12345", "tomorrow", "dev"), (None, "2026-01-01 00:00", None)], "h string, t string, s string")
    out = rows(df.select(records.phash_bits(F.col("h")), F.unix_micros(records.instant(F.col("t"))), records.split_name(F.col("s"))))
    assert out == [(-1, 1767225600000000, "train"), (None, None, None), (None, None, None)]
    forms = df.limit(1).select(records.number_form(F.lit("1024.0")), records.number_form(F.lit(" 1024")), records.number_form(F.lit("1.024e3")), records.number_form(F.lit("x")), records.boolean_form(F.lit("YES"))).head()
    assert forms[0] == forms[1] == forms[2] and forms[3] == "x" and forms[4] == "true"


def test_text_functions(spark):
    one = spark.range(1)
    aliases = [("bell pepper", "pepper"), ("corn", "corn")]
    got = one.select(
        text.label_form(F.lit("Bell__pepper-leaf___Spot")),
        text.first_alias(F.lit("bell pepper leaf spot"), aliases),
        text.first_alias(F.lit("unicorn"), aliases),
        text.remainder(F.lit("bell pepper leaf spot"), aliases),
        text.remainder(F.lit("corn healthy"), aliases),
        text.remainder(F.lit("corn leaf"), aliases),
        text.canonical_name(F.lit("Corn"), F.lit("Rust, late")),
        text.embedded_token(F.lit("Cause UNKNOWN yet"), ["unknown", "tbd"]),
        text.embedded_token(F.lit("the latest"), ["test"]),
        text.fold_key(F.lit("Größe")),
        text.identity_key(F.lit("  Ａda\tL ")),
        text.tag_after(F.lit("a/b/uuid___TAG 1.JPG")),
        text.collision_safe(F.lit("a/b.c.png"), F.lit("0123456789abcdef")),
        text.p_text(F.lit(0.00001)),
    ).head()
    assert list(got) == ["bell pepper leaf spot", "pepper", "", "spot", "healthy", "corn leaf", "corn__rust_late", "unknown", None, "grösse", "ada l", "TAG 1", "a/b.c__0123456789ab.png", "<0.0001"]
    with pytest.raises(Exception, match="12 digits"):
        one.select(text.collision_safe(F.lit("a.png"), F.lit("abc"))).collect()


def test_hash_functions(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000001")], "a string, b string")
    assert df.select(hashes.hamming_hex(F.col("a"), F.col("b"))).head()[0] == 63
    wide = spark.createDataFrame([([1, -1], [0, 0])], "a array<long>, b array<long>")
    assert wide.select(hashes.hamming_words(F.col("a"), F.col("b"))).head()[0] == 65
    x = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    y = x.orderBy(F.desc("k"))
    assert rows(hashes.set_digest(x, F.col("k"))) == rows(hashes.set_digest(y, F.col("k")))
    assert rows(hashes.set_digest(x, F.col("k"))) != rows(hashes.set_digest(x.union(x), F.col("k")))
    assert rows(hashes.set_digest(x.limit(0), F.col("k")))[0][0] == 0


def test_compare_copies(spark):
    a = spark.createDataFrame([("k1", "x", 1, "extra"), ("k2", None, 2, "e"), ("k3", "y", 3, None), ("k3", "y", 3, None), (None, "z", 9, "")], "key string, f string, n int, side string")
    b = spark.createDataFrame([("k1", "x", "1.0"), ("k2", "", "5"), ("k4", "q", "1"), ("k4", "q", "1")], "key string, f string, n string")
    c = F.col
    got = reconcile.compare_copies(a, b, c("key"), c("key"), {"f": c("f"), "n": records.number_form(c("n").cast("string"))}, {"f": c("f"), "n": records.number_form(c("n"))})
    assert sorted(rows(got)) == [("k2", "value_mismatches", "n"), ("k3", "missing_records", ""), ("k4", "extra_records", "")]
    empty = reconcile.compare_copies(a.limit(0), b, c("key"), c("key"), {"f": c("f")}, {"f": c("f")})
    assert sorted(r[1] for r in rows(empty)) == ["extra_records"] * 3


def test_reconcile_sets_by_identity_not_count(spark):
    a = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    b = spark.createDataFrame([("b",), ("c",), ("d",), (None,)], "id string")
    got = {r.id: r.outcome for r in reconcile.reconcile_sets(a, b, ["id"]).collect()}
    assert got == {"a": "fresh_only", "b": "duplicate", "c": "persisted_only", "d": "persisted_only"}
    assert rows(reconcile.multiset_shortfall(a, b), "id") == [("a",), ("b",)]


def test_orphans_against_brute_force(spark):
    r = random.Random(3)
    parents = [(f"p{r.randint(0, 60)}", r.choice([None, r.randint(0, 50)]), r.choice([None, r.randint(20, 80)])) for _ in range(80)]
    refs = [(i, r.choice([None, f"p{r.randint(0, 90)}"]), r.choice([None, r.randint(0, 90)]), "clash") for i in range(300)]
    refs += [(i, "p1", 70, "clash") for i in range(300, 400)]
    got = references.orphans(spark.createDataFrame(refs, "id int, key string, at int, word string"), spark.createDataFrame(parents, "key string, since int, until int"))

    def live(k, t):
        return any(p == k and (t is None or ((s is None or s <= t) and (u is None or t < u))) for p, s, u in parents)

    assert sorted(x.id for x in got.collect()) == [i for i, k, t, _ in refs if k is not None and not live(k, t)]
    assert references.orphans(spark.createDataFrame(refs, "id int, key string, at int, word string").limit(0), spark.createDataFrame(parents, "key string, since int, until int")).count() == 0
    none_held = references.orphans(spark.createDataFrame([(1, "a", 1)], "id int, key string, at int"), spark.createDataFrame([], "key string, since int, until int"))
    assert none_held.count() == 1


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("strategy", ["blocked", "banded"])
def test_near_pairs_against_brute_force(spark, monkeypatch, seed, strategy):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(12)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def near(n):
        out = []
        for i in range(n):
            h = r.choice(base)
            for _ in range(r.randint(0, 4)):
                h ^= 1 << r.randint(0, 63)
            out.append((i, h))
        return out

    a, b = near(60), near(50)
    t = r.choice([0, 1, 3, 6])
    da = spark.createDataFrame([(i, signed(h)) for i, h in a] + [(999, None)], "id int, h long")
    db = spark.createDataFrame([(i, signed(h)) for i, h in b], "id int, h long")
    d = lambda x, y: bin(x ^ y).count("1")
    cross = sorted((i, j, d(x, y)) for i, x in a for j, y in b if 0 < d(x, y) <= t)
    assert sorted(rows(neardup.near_pairs(da, db, t, strategy))) == cross
    if t and strategy == "banded":
        for equal in (2, 3):
            monkeypatch.setattr(neardup, "bands_for", lambda *_, m=equal: (t + m, m))
            assert sorted(rows(neardup.near_pairs(da, db, t, strategy))) == cross
        monkeypatch.undo()
    within = sorted((i, j, d(x, y)) for i, x in a for j, y in a if i < j and 0 < d(x, y) <= t)
    assert sorted(rows(neardup.near_pairs(da, None, t, strategy))) == within


def test_near_threshold_is_checked(spark):
    assert neardup.bands_for(1000, 1000, 6) == (7, 1) and neardup.bands_for(10**7, 10**7, 6)[1] > 1
    for bad in (-1, 64, True, 1.5):
        with pytest.raises(ValueError):
            neardup.check_threshold(bad)


def test_profile_edges(spark):
    empty = spark.createDataFrame([], "split string, class_label string, is_corrupt boolean, relpath string, sha256 string")
    assert profile.split_summary(empty).count() == 0
    assert rows(profile.coverage(empty, F.lit(True))) == [(0, 0, None, "unavailable")]
    assert rows(profile.all_hold(empty, F.lit(True))) == [(False,)]
    g = spark.createDataFrame([("d", "train", "a", "p1"), ("d", "test", "b", "p2"), ("d", "test", "b", "p2"), ("e", "train", "a", "p3"), (None, "train", "a", "p4")], "dg string, split string, l string, p string")
    groups = profile.content_groups(g, F.col("dg"), F.col("split"), F.col("l"), F.col("p"))
    assert rows(groups) == [("d", 2, 2, 2, "p1")]
    assert rows(profile.group_breakdown(groups))[0][:5] == (1, 2, 1, 1, 1)


def test_action_accuracy_policies(spark):
    pred = spark.createDataFrame([(0, 0), (0, 9), (9, 0)], "y_true int, y_pred int")
    p = metrics.project(pred, spark.createDataFrame([(0, "a")], "label int, action string"))
    strict, lax = metrics.action_accuracy(p).head(), metrics.action_accuracy(p, "exclude").head()
    assert (strict.n_included, strict.n_correct, strict.n_excluded) == (2, 1, 1)
    assert (lax.n_included, lax.n_correct, lax.n_excluded) == (1, 1, 2)
    with pytest.raises(ValueError):
        metrics.action_accuracy(p, "other")
    assert metrics.action_accuracy(p.limit(0)).head().accuracy is None


def test_selective_known_answers(spark, scratch):
    df = spark.createDataFrame([(1, 0.9, True), (2, 0.4, False), (3, 0.8, True), (4, 0.3, False)], "item_id long, conf double, correct boolean")
    curve = {r.threshold: r for r in calibration.risk_coverage(df, "correct", scratch).collect()}
    assert curve[0.0].coverage == 1.0 and curve[0.0].mean == 0.5
    assert all(r.mean == 1.0 for t, r in curve.items() if t > 0.5)
    harm = spark.createDataFrame([(0.9, 0.0), (0.2, 4.0)], "conf double, cost double")
    h = sorted(calibration.risk_coverage(harm, "cost", scratch).collect(), key=lambda r: r.threshold)
    assert h[0].mean == 2.0 and h[-1].mean == 0.0
    assert calibration.abstention_curve(df.limit(0), scratch).count() == 0


def test_inference_known_answers(spark):
    df = spark.createDataFrame([(34, 60), (20, 17), (0, 0)], "b long, c long")
    p = [r[0] for r in df.select(inference.exact_p("b", "c")).collect()]
    assert p[0] == pytest.approx(0.009548, abs=1e-6) and p[1] == pytest.approx(0.742829, abs=1e-6) and p[2] == 1.0
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.p_holm, 6) for r in inference.holm(t, "p", ["k"], Scratch(spark)).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_bca_brackets_the_estimate_and_repeats(spark):
    cells = spark.createDataFrame([("m", 0, 0, 80), ("m", 0, 1, 20), ("m", 1, 1, 90), ("m", 1, 0, 10)], "run string, y_true int, y_pred int, n long")
    a = rows(inference.bca_intervals(cells, ["run"], 2, draws=2000), "statistic")
    assert a == rows(inference.bca_intervals(cells, ["run"], 2, draws=2000), "statistic")
    assert all(x[3] < x[2] < x[4] and x[5] == "bca" for x in a)
    sure = inference.bca_intervals(cells.where("y_true = y_pred"), ["run"], 2, draws=200)
    assert {r.method for r in sure.collect()} == {"percentile"}


def test_temperature_recovers_scale(spark):
    r = random.Random(1)
    import math

    data = []
    for _ in range(3000):
        z = [r.gauss(0, 1) for _ in range(3)]
        w = [math.exp(x) for x in z]
        y = r.choices(range(3), weights=w)[0]
        data.append((y, [2.5 * x for x in z]))
    t = calibration.fit_temperature(spark.createDataFrame(data, "y_true int, logits array<double>"))
    assert t == pytest.approx(2.5, rel=0.12)


def test_rules_and_guards(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", -1)], "k string, n int")
    found = rules.violations(df, [("error", "negative", F.col("n") < 0)], F.col("k"))
    assert sorted(r["where"] for r in found.collect()) == ["b", "c"]
    with pytest.raises(ValueError, match="negative"):
        rules.require_none(found, "table")
    rules.require_none(found.limit(0), "table")
    with pytest.raises(ValueError):
        rules.require_some(df.limit(0), "lookup")
    times = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01 00:00",), ("now",), (None,), ("2026-13-01T00:00:00Z",), ("2999-01-01T00:00:00Z",)], "t string")
    assert [r[0] for r in times.select(rules.timestamp_problem(F.col("t"), F.current_timestamp())).collect()] == [None, "no offset", "malformed", "missing", "invalid", "in the future"]


def test_authentication_rejects_forgery_at_equal_counts(spark):
    known = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, d string")
    claims = spark.createDataFrame([("a", "x"), ("c", "y")], "id string, d string")
    got = sorted(rows(rules.authenticate(claims, known, ["id"], ["d"])))
    assert got == [("b", "unclaimed", ""), ("c", "unknown", "")]
    assert rows(rules.authenticate(known, known, ["id"], ["d"])) == []
    assert rows(rules.authenticate(spark.createDataFrame([("a", "q"), ("b", "y")], "id string, d string"), known, ["id"], ["d"])) == [("a", "mismatch", "d")]
    assert rules.gate(spark.createDataFrame([("x", 0), ("y", None)], "check string, n_problems long")).head().status == "incomplete"


def test_crosswalk_remainder_and_merge(spark):
    left = spark.createDataFrame([("Corn_rust", "corn", "rust"), ("Fig_spot", "fig", "spot"), ("Soil", "", "soil")], "label string, crop string, state string")
    right = spark.createDataFrame([("corn leaf rust", "corn", "rust"), ("corn mold", "corn", "mold")], "label string, crop string, state string")
    got = {(r.left_label, r.right_label): (r.included, r.reason) for r in crosswalk.crosswalk(left, right).collect()}
    assert got[("Corn_rust", "corn leaf rust")] == (True, "")
    assert got[("Fig_spot", None)][1] == "crop only on one side" and got[("Soil", None)][1] == "no crop" and got[(None, "corn mold")][1] == "state only on one side"
    fresh = spark.createDataFrame([("a",), ("b",)], "id string")
    held = spark.createDataFrame([("a", "keep"), ("z", "drop"), ("y", "")], "id string, decision string")
    assert {r.id: r.outcome for r in crosswalk.merge_decisions(fresh, held, "id", ["decision"], "decision").collect()} == {"a": "kept", "b": "new", "z": "lost"}


def test_remediation(spark):
    m = spark.createDataFrame([("g", "b", "train"), ("g", "a", "test"), ("h", "d", "test"), ("h", "c", None), (None, "e", "train")], "g string, p string, s string")
    assert rows(remediation.canonical_members(m, "g", "p", "s", "train"), "g") == [("g", "b"), ("h", "c")]
    recs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "p string, l string")
    out = spark.createDataFrame([("a", "drop", None), ("b", "keep", "Y")], "p string, act string, lab string")
    eff = remediation.effective_records(recs, out, "p", F.col("act") == "keep", {"l": "lab"})
    assert rows(eff, "p") == [("b", "Y"), ("c", "z")]
    assert sorted(rows(remediation.verify_effective(recs, eff, "p", ["l"]))) == [("a", "dropped", ""), ("b", "changed", "l")]
    left, problems = remediation.excluded(recs, spark.createDataFrame([("a", "x"), ("b", "WRONG"), ("q", "x")], "p string, l string"), "p", ["l"])
    assert rows(left) == [("c", "z")] and sorted(rows(problems)) == [("b", "l"), ("q", "no such record")]


def test_grouped_split_keeps_groups_whole(spark, scratch):
    data = [(f"p{c}{i:03d}", f"c{c}", f"leaf{c}-{i // 4}" if i % 7 else None) for c in range(4) for i in range(40)] + [("solo", "tiny", None)]
    df = spark.createDataFrame(data, "relpath string, class_label string, leaf_id string")
    out = splits.grouped_split(df, "class_label", "leaf_id", "relpath", 0.25, 11, scratch).collect()
    sides = {}
    for r in out:
        sides.setdefault(r.leaf_id or r.relpath, set()).add(r.side)
    assert len(out) == len(data) and all(len(s) == 1 for s in sides.values())
    assert {r.side for r in out if r.class_label == "tiny"} == {"train"}
    again = splits.grouped_split(df.repartition(5), "class_label", "leaf_id", "relpath", 0.25, 11, scratch).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)
    for bad in (0, 1):
        with pytest.raises(ValueError):
            splits.grouped_split(df, "class_label", "leaf_id", "relpath", bad, 1, scratch)


def test_ranks_and_running_sums_with_a_hot_key(spark, scratch):
    data = [("hot" if i % 3 else f"k{i % 50}", i) for i in range(900)] + [(None, 5000), (None, 5001)]
    df = spark.createDataFrame(data, "k string, i int")
    by = {}
    for r in ranked(df, ["k"], ["i"], 16).collect():
        by.setdefault(r.k, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == len(data)
    run = running_sums(df, [F.asc("i")], {"s": F.lit(1).cast("long")}, scratch).collect()
    assert sorted((r.i, r.s) for r in run) == [(i, n + 1) for n, i in enumerate(sorted(i for _, i in data))]
    n = {}
    for r in sorted(numbered(df, ["k"], ["i"], scratch).collect(), key=lambda r: r.i):
        n.setdefault(r.k, []).append(r.n)
    assert all(v == list(range(1, len(v) + 1)) for v in n.values())


def test_bloom_filter_loses_no_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = references.filter_words(5000)
    held = references.bloom_filter(keys, "key", words)
    assert held.count() <= words // references.ROW_WORDS
    probes = spark.range(10000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    out = references.orphans(probes.withColumn("at", F.lit(1)), keys.withColumn("since", F.lit(None).cast("int")).withColumn("until", F.lit(None).cast("int")))
    assert sorted(r.id for r in out.collect()) == list(range(5000, 10000))
    assert references.filter_words(10**12) > references.MOST_WORDS and references.filter_words(0) == references.ROW_WORDS


def test_tiers_and_interpolation(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.0501,), (1.01,), (2.0,), (-0.1,), (None,)], "x double")
    got = [r[0] for r in df.select(calibration.tiers(F.col("x"), [0, 0.05, 0.15, 0.35, 1.01], ["a", "b", "c", "d"])).collect()]
    assert got == ["a", "a", "b", "d", None, None, None]
    with pytest.raises(ValueError):
        calibration.tiers(F.col("x"), [0, 1], ["a", "b"])
    curve = spark.createDataFrame([("r", 0.0, 0.0), ("r", 0.5, 1.0), ("r", 1.0, 0.0), ("one", 0.3, 1.0), ("r", None, 3.0)], "run string, x double, y double")
    pts = {(r.run, r.point): r.y for r in calibration.interpolated(curve, "run", "x", "y", grid=4).collect()}
    assert pts == {("r", 1): 0.5, ("r", 2): 1.0, ("r", 3): 0.5, ("r", 4): 0.0}


def test_numbers_verdicts_and_references(spark, scratch):
    held = spark.createDataFrame([("a", 7)], "id string, n long")
    got = remediation.minted(spark.createDataFrame([("a",), ("c",), ("b",)], "id string"), held, "id", "n", ["id"], scratch)
    assert rows(got, "id") == [("b", 8), ("c", 9)]
    m = spark.createDataFrame([("g", "A", "x"), ("g", "a", "x"), ("h", "a", "x"), ("h", "b", "x"), ("i", "a", "x"), ("i", "b", "y"), ("j", None, None)], "g string, s string, d string")
    assert {r.g: r.verdict for r in remediation.pair_verdicts(m, "g", "s", "d").collect()} == {"g": "byte-identical", "h": "re-encoded", "i": "different", "j": "unknown"}
    late = rules.before_reference(spark.createDataFrame([("k", 1), ("k", 9), ("q", 5), ("k", None)], "key string, at int"), spark.createDataFrame([("k", 3)], "key string, ref int"), "key", "at", "ref")
    assert sorted((r.key, r.problem) for r in late.collect()) == [("k", "no time"), ("k", "too early"), ("q", "no reference")]
    urls = spark.createDataFrame([("https://x.org/a",), ("ftp://x",), ("x.org",), (" ",), (None,)], "u string")
    assert [r[0] for r in urls.select(rules.url_problem(F.col("u"))).collect()] == [None, "scheme", "no address", "missing", "missing"]
    with pytest.raises(ValueError):
        one = spark.range(1).select(F.lit(1).alias("c"))
        reconcile.named_facts({"a_b": one.select(F.col("c").alias("d")), "a": one.select(F.col("c").alias("b_d"))})


def test_metrics_on_empty_tables(spark, scratch):
    pred = spark.createDataFrame([], "item_id long, y_true int, y_pred int, conf double, correct boolean, probs array<double>")
    assert metrics.top1(pred).head().accuracy is None
    assert metrics.summary(metrics.per_class(metrics.confusion(pred))).head().accuracy is None
    assert calibration.likelihood(pred).head().n == 0
    assert [r.n for r in calibration.bins(pred, 3).collect()] == [0, 0, 0]
    assert calibration.calibration_error(calibration.bins(pred, 3)).head().ece is None
    assert rows(calibration.at_threshold(pred, 0.5, "correct")) == [(0.0, None)]
    assert rows(calibration.risk_coverage(pred, "correct", scratch)) == [(0.0, 0, 0, None, None)]
    one = metrics.mean_sd(spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None)], "k string, v double"), ["k"], ["v"]).head()
    assert (one.v_mean, one.v_sd, one.v_n) == (1.0, None, 1)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0, True), (0.2, True), (0.2000001, False), (1.0, True), (None, True)], "conf double, correct boolean")
    assert [r.n for r in calibration.bins(df, 5).orderBy("bin").collect()] == [2, 1, 0, 0, 1]


def test_number_forms_are_exact(spark):
    same = [["1024", " 1024.0", "1.024e3", "+1024", "01024.00", "1_024", "102400E-2"], ["0", "-0", "0.00", "0e5", ".0"], ["0.000001", "1e-6", "0.1E-5"], ["-2.5", "-25e-1"], ["1e10", "10000000000.0"]]
    other = ["1.0000001", "1.0000002", "12345678901234567890123456789012345678901234567890.1", "12345678901234567890123456789012345678901234567890.2", "x", "", ".", "-", "1e", "1e9999", "NaN"]
    texts = [x for group in same for x in group] + other
    form = {r.t: r.f for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", records.number_form(F.col("t")).alias("f")).collect()}
    for group in same:
        assert len({form[x] for x in group}) == 1, group
    assert len({form[g[0]] for g in same} | {form[x] for x in other}) == len(same) + len(other)
    assert form["1.024e3"] == "1024" and form["1e-6"] == "0.000001" and form["-25e-1"] == "-2.5"


def test_exact_p_of_large_counts(spark):
    from math import comb

    pairs = [(0, 0), (1, 0), (3, 11), (11, 3), (40, 40), (40, 41), (0, 60), (500, 420)]
    big = [(10**9, 10**9 + 1000), (10**9, 10**9 + 200_000), (5 * 10**8, 5 * 10**8)]
    got = [r[0] for r in spark.createDataFrame(pairs + big, "b long, c long").coalesce(1).select(inference.exact_p("b", "c")).collect()]
    for (b, c), p in zip(pairs, got):
        n, m = b + c, min(b, c)
        assert p == pytest.approx(min(1.0, 2 * sum(comb(n, k) for k in range(m + 1)) / 2**n), rel=1e-9)
    # The normal tail with half a step is close at such counts.
    from statistics import NormalDist

    assert got[-3] == pytest.approx(2 * NormalDist().cdf(-(1000 - 1) / (2 * 10**9) ** 0.5), rel=1e-3)
    assert got[-2] == pytest.approx(2 * NormalDist().cdf(-(200_000 - 1) / (2 * 10**9) ** 0.5), rel=1e-2) and got[-1] == 1.0


def test_medians_by_ranges(spark, scratch):
    import statistics

    rows_ = [(i % 7, str(i * i % 31), None if i % 3 else 2) for i in range(40)] + [(3, "x", None)] * 30
    df = spark.createDataFrame(rows_, "a int, b string, c int")
    got = profile.exact_medians(df, ["a", "b", "c"], scratch).head()
    assert got.median_a == statistics.median(a for a, _, _ in rows_)
    assert got.median_b == statistics.median(float(b) for _, b, _ in rows_ if b != "x") and got.median_c == 2.0
    assert tuple(profile.exact_medians(df.limit(0), ["a", "b"], scratch).head()) == (None, None)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_running_folds_over_many_ranges(spark, scratch, parts):
    """A third of the rows share one order value's neighbourhood; sums and maxima go over all ranges."""
    values = [(i, (i * 37) % 11) for i in range(60)] + [(1000 + i, 1) for i in range(30)]
    df = spark.createDataFrame(values, "k int, v int").repartition(5)
    sums = running_sums(df, [F.col("k")], {"s": F.col("v")}, scratch, parts)
    tops = running_sums(df, [F.col("k")], {"s": F.col("v")}, scratch, parts, F.max)
    total, most, want, top = 0, -1, {}, {}
    for k, v in sorted(values):
        total, most = total + v, max(most, v)
        want[k], top[k] = total, most
    assert {r.k: r.s for r in sums.collect()} == want and {r.k: r.s for r in tops.collect()} == top


def test_filter_that_is_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(references, "MOST_WORDS", 8)
    parents = spark.createDataFrame([(f"k{i}", None, None) for i in range(300)], "key string, since timestamp, until timestamp")
    refs = spark.createDataFrame([(i, f"k{i}") for i in range(0, 600, 3)] + [(9000 + i, "hot") for i in range(100)] + [(1, None)], "n int, key string").withColumn("at", F.lit(None).cast("timestamp"))
    got = {r.n for r in references.orphans(refs, parents).collect()}
    assert got == {i for i in range(300, 600, 3)} | set(range(9000, 9100))


def test_conflicting_rows(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("b", "1", 1), ("b", None, 1), ("b", "2", 1), ("c", None, 1), (None, "1", 1), (None, "2", 1)], "key string, f string, extra int")
    assert [tuple(r) for r in reconcile.conflicting_rows(df, F.col("key"), {"f": F.col("f")}).collect()] == [("b", 3)]


@pytest.mark.parametrize("bits,threshold", [(64, 3), (128, 6), (256, 9)])
def test_wide_search_against_all_pairs(spark, bits, threshold):
    r = random.Random(bits)
    base = [r.getrandbits(bits) for _ in range(6)]

    def some(n):
        return [h ^ sum({1 << r.randint(0, bits - 1) for _ in range(r.randint(0, threshold))}) for h in (r.choice(base) for _ in range(n))]

    def words(h):
        return [(x - (1 << 64) if x >> 63 else x) for x in ((h >> 64 * i) & (1 << 64) - 1 for i in range(bits // 64))]

    a, b = some(40), some(40)
    frame = lambda x: spark.createDataFrame([*((i, words(h)) for i, h in enumerate(x)), (99, None), (0, words(x[0]))], "id int, h array<long>")
    got = [tuple(x) for x in neardup.near_wide(frame(a), frame(b), threshold, bits).collect()]
    want = {(i, j, (x ^ y).bit_count()) for i, x in enumerate(a) for j, y in enumerate(b) if (x ^ y).bit_count() <= threshold}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(Exception, match="another width"):
        neardup.near_wide(frame(a), spark.createDataFrame([(1, [1] * 5)], "id int, h array<long>"), threshold, bits).collect()


def test_hashes_are_refused_or_reported(spark):
    df = spark.createDataFrame([("0123456789abcdef",), (" 0x0123456789ABCDEF",), (None,)], "p string")
    assert neardup.require_hashes(df, "p").count() == 3
    bad = df.union(spark.createDataFrame([("xyz",), ("",), ("0123",)], "p string"))
    assert neardup.malformed(bad, "p").count() == 3
    with pytest.raises(ValueError, match="16 hexadecimal digits"):
        neardup.require_hashes(bad, "p")
    assert neardup.malformed(spark.createDataFrame([("ab" * 32,)], "p string"), "p", 64).isEmpty()


def test_pairs_outside_and_classes(spark):
    a = spark.createDataFrame([(1, 0), (1, 0), (2, 0)], "id long, h long")
    b = spark.createDataFrame([(7, 1, True), (7, 3, False), (8, 1, None), (8, 1, False), (9, None, False)], "id long, h long, inside boolean")
    assert sorted(map(tuple, neardup.pairs_outside(a, b, "inside", 2).collect())) == [(1, 8), (2, 8)]
    assert sorted(map(tuple, neardup.near_classes(a, b, 2).collect())) == [(0, 1, 1, 2, 2), (0, 3, 2, 2, 1)]


def test_position_differences(spark):
    kind = "g string, p int, name string, extra int"
    a = spark.createDataFrame([("x", 1, "a", 0), ("x", 2, "b", 0), ("x", 3, None, 0), (None, 1, "n", 0), ("y", 1, "c", 0)], kind)
    b = spark.createDataFrame([("x", 1, "b", 9), ("x", 2, "a", 9), ("x", 3, None, 9), (None, 1, "n", 9), ("y", 1, "c", 9), ("y", 1, "c", 9), ("z", 1, "d", 9)], kind)
    got = {tuple(r) for r in reconcile.position_differences(a, b, "g", "p", ["name"]).collect()}
    assert got == {("x", 1, "changed", "name"), ("x", 2, "changed", "name"), ("y", 1, "repeated", None), ("z", 1, "extra", None)}
    assert reconcile.position_differences(a.limit(0), b.limit(0), "g", "p", ["name"]).isEmpty()


def test_typeset_and_linear_models(spark):
    df = spark.createDataFrame([("a_b & 5% \\\\ {x}~^", [1.0, 2.0]), ("", [1.0]), (None, None)], "t string, v array<double>")
    got = [r[0] for r in df.select(text.typeset(F.col("t"))).collect()]
    assert got[0] == "a\\_b \\& 5\\% " + "\\textbackslash{}" * 2 + " \\{x\\}\\textasciitilde{}\\textasciicircum{}" and got[1:] == ["", None]
    logits = metrics.linear_logits(F.col("v"), [[1, 0], [0, 1], [0, 1]], [0, 0.5, 0.5])
    assert [tuple(r) for r in df.select(logits, metrics.first_best(logits)).collect()] == [([1.0, 2.5, 2.5], 1), (None, None), (None, None)]
    with pytest.raises(ValueError):
        metrics.linear_logits(F.col("v"), [[1], [1, 2]], [0, 0])
