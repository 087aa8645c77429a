"""Queries on predictions and runs: metrics, calibration, curves, tests and roll-ups over seeds.

Predictions come from line items by fixed arithmetic, so that both engines compute the same labels and scores; runs
come from the calibration table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.operators import calibration, inference, metrics
from mullion.plans.manifests import rounded, table
from mullion.scale import Scratch

QUERIES, SQL = {}, {}
LABELS, ACTIONS = range(5), ("monitor", "prune", "spray")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def predictions(spark: SparkSession, sf: str, run: int = 0) -> DataFrame:
    """(item_id, y_true, y_pred, conf, correct, logits) of one pseudo-model."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    y = (F.col("l_quantity").cast("int") % 5).alias("y_true")
    guess = F.when((F.col("l_partkey") + run * 7) % 10 < 6 + run, F.col("y_true")).otherwise(((F.col("l_suppkey") + run) % 5).cast("int"))
    logits = F.array(*[(F.col("l_partkey") * (j + 3) + F.col("l_suppkey") * 7 + j * j * 11) % 17 / 4.0 + F.when(F.col("y_true") == j, 1.5).otherwise(0.0) for j in LABELS])
    rows = li.select(F.expr("(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 5 + cast(l_quantity as int) % 5").alias("item_id"), y, "l_partkey", "l_suppkey")
    rows = rows.select("item_id", "y_true", guess.alias("y_pred"), (((F.col("l_partkey") * 13 + F.col("l_suppkey")) % 997 + 1) / 997.0).alias("conf"), logits.alias("logits"))
    return rows.withColumn("correct", F.col("y_true") == F.col("y_pred"))


def pred_sql(run: int = 0) -> str:
    logits = ", ".join(f"(l_partkey * {j + 3} + l_suppkey * 7 + {j * j * 11}) % 17 / 4.0 + case when y = {j} then 1.5 else 0 end" for j in LABELS)
    return f"""(select *, y_true = y_pred as correct from (select item_id, y as y_true, cast(case when (l_partkey + {run * 7}) % 10 < {6 + run} then y else (l_suppkey + {run}) % 5 end as integer) as y_pred,
    ((l_partkey * 13 + l_suppkey) % 997 + 1) / cast(997 as double) as conf, [cast(x as double) for x in [{logits}]] as logits
    from (select (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 5 + cast(l_quantity as integer) % 5 as item_id, cast(l_quantity as integer) % 5 as y, l_partkey, l_suppkey from lineitem)))"""


P = pred_sql()
PROBS = f"""(select *, [x / tot for x in ex] as probs from (select *, list_sum(ex) as tot from (select *, [exp(x - list_max(logits)) for x in logits] as ex from {P})))"""


def with_probs(spark, sf):
    return predictions(spark, sf).withColumn("probs", metrics.softmax(F.col("logits")))


LOOKUP = [(0, "spray"), (1, "spray"), (2, "prune"), (3, "monitor")]
COSTS = [(a, b, 0.0 if a == b else 1.0 + 2 * i + j) for i, a in enumerate(ACTIONS) for j, b in enumerate(ACTIONS)]


def projected(spark, sf):
    return metrics.project(predictions(spark, sf), spark.createDataFrame(LOOKUP, "label int, action string"))


LK = "(values " + ", ".join(f"({a}, '{b}')" for a, b in LOOKUP) + ")"
CK = "(values " + ", ".join(f"('{a}', '{b}', cast({c} as double))" for a, b, c in COSTS) + ")"
J = f"(select p.*, t.a as ta, q.a as pa from {P} p left join {LK} t(l, a) on p.y_true = t.l left join {LK} q(l, a) on p.y_pred = q.l)"
CELLS = f"(select y_true, y_pred, count(*) as n from {P} group by 1, 2)"
PER = f"""(select label, cast(sum(tp) as bigint) as tp, cast(sum(s) as bigint) as support, cast(sum(p) as bigint) as predicted from (
select y_true as label, case when y_true = y_pred then n else 0 end as tp, n as s, 0 as p from {CELLS} union all select y_pred, 0, 0, n from {CELLS} union all select * from (values (5, 0, 0, 0)) v(a, b, c, d)) group by 1)"""
SCORED = f"""(select *, case when predicted > 0 then tp / predicted else 0 end as precision, case when support > 0 then tp / support else 0 end as recall, case when support + predicted > 0 then 2 * tp / (support + predicted) else 0 end as f1 from {PER})"""


@query("confusion_cells", f"select * from {CELLS}")
def _(spark, sf):
    return metrics.confusion(predictions(spark, sf))


@query("confusion_dense", f"select y_true, {', '.join(f'count(*) filter (where y_pred = {x}) as pred_{x}' for x in LABELS)} from {P} group by 1")
def _(spark, sf):
    return metrics.dense_confusion(predictions(spark, sf), list(LABELS))


@query("confusion_normalised", f"select y_true, y_pred, round(n / sum(n) over (partition by y_true), 6) as share from {CELLS}")
def _(spark, sf):
    return rounded(metrics.normalised_confusion(predictions(spark, sf)))


@query("per_class_scores", f"select label, tp, support, predicted, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from {SCORED}")
def _(spark, sf):
    return rounded(metrics.per_class(metrics.confusion(predictions(spark, sf)), labels=[*LABELS, 5]))


@query("classification_summary", f"""select cast(sum(support) as bigint) as n, round(sum(tp) / sum(support), 6) as accuracy, round(avg(precision) filter (where support > 0), 6) as macro_precision, round(avg(recall) filter (where support > 0), 6) as macro_recall,
round(avg(f1) filter (where support > 0), 6) as macro_f1, round(avg(f1), 6) as macro_f1_all, round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(avg(recall) filter (where support > 0), 6) as balanced_accuracy,
cast(coalesce(sum(predicted) filter (where support = 0), 0) as bigint) as predicted_without_support from {SCORED}""")
def _(spark, sf):
    return rounded(metrics.summary(metrics.per_class(metrics.confusion(predictions(spark, sf)), labels=[*LABELS, 5])))


@query("top1_accuracy", f"select round(avg(cast(correct as integer)), 6) as accuracy from {P}")
def _(spark, sf):
    return rounded(metrics.top1(predictions(spark, sf)))


def _action_sql(taken: str) -> str:
    return f"""select count(*) as n_total, count(*) filter (where {taken}) as n_included, count(*) filter (where {taken} and ta = pa) as n_correct, count(*) filter (where ta is null) as n_unmapped_true,
    count(*) filter (where ta is not null and pa is null) as n_unmapped_pred, count(*) - count(*) filter (where {taken}) as n_excluded, round(count(*) filter (where {taken} and ta = pa) / count(*) filter (where {taken}), 6) as accuracy from {J}"""


@query("action_accuracy_incorrect", _action_sql("ta is not null"))
def _(spark, sf):
    return rounded(metrics.action_accuracy(projected(spark, sf)))


@query("action_accuracy_exclude", _action_sql("ta is not null and pa is not null"))
def _(spark, sf):
    return rounded(metrics.action_accuracy(projected(spark, sf), "exclude"))


@query("action_distribution", f"select ta as action, count(*) as n from {J} where ta is not null group by 1")
def _(spark, sf):
    return metrics.action_counts(projected(spark, sf))


@query("action_majority", f"select arg_min(a, (-n, a)) as action, round(max(n) / sum(n), 6) as accuracy from (select ta as a, count(*) as n from {J} where ta is not null group by 1)")
def _(spark, sf):
    return rounded(metrics.action_majority(projected(spark, sf)))


@query("action_confusion", f"select ta as true_action, {', '.join(f'''count(*) filter (where coalesce(pa, 'unmapped') = '{a}') as pred_{a}''' for a in [*ACTIONS, 'unmapped'])} from {J} where ta is not null group by 1")
def _(spark, sf):
    return metrics.action_confusion(projected(spark, sf), ACTIONS)


@query("action_report", f"select round(l, 6) as label_accuracy, round(a, 6) as action_accuracy, round(a - l, 6) as gain from (select avg(cast(correct as integer)) as l, count(*) filter (where ta = pa) / count(*) filter (where ta is not null) as a from {J})")
def _(spark, sf):
    return rounded(metrics.action_report(projected(spark, sf)))


def _cost_sql(cost: str) -> str:
    return f"""select count(*) as n_total, count({cost}) as n_included, count(*) filter (where ta is null) as n_unmapped_true, count(*) filter (where ta is not null and pa is null) as n_unmapped_pred,
    cast(0 as bigint) as n_without_cost, round(avg({cost}), 6) as mean_cost from {J} left join {CK} k(x, y, c) on ta = x and pa = y"""


@query("mean_cost_exclude", _cost_sql("c"))
def _(spark, sf):
    return rounded(metrics.mean_cost(projected(spark, sf), spark.createDataFrame(COSTS, "true_action string, pred_action string, cost double")))


@query("mean_cost_charged", _cost_sql("(case when ta is not null and pa is null then 5.0 else c end)"))
def _(spark, sf):
    return rounded(metrics.mean_cost(projected(spark, sf), spark.createDataFrame(COSTS, "true_action string, pred_action string, cost double"), 5.0))


@query("cost_table_gaps", "select * from (values ('prune', 'spray', 'missing'), ('spray', 'spray', 'diagonal'), ('monitor', 'prune', 'negative')) v(true_action, pred_action, problem)")
def _(spark, sf):
    bad = [(a, b, -1.0 if (a, b) == ("monitor", "prune") else 2.0 if a == b == "spray" else c) for a, b, c in COSTS if (a, b) != ("prune", "spray")]
    return metrics.cost_gaps(spark.createDataFrame(bad, "true_action string, pred_action string, cost double"), ACTIONS)


@query("scoped_lookup", "select y_true, count(*) as n from (select cast(l_quantity as integer) % 5 as y_true from lineitem) where y_true not in (1, 3) group by 1")
def _(spark, sf):
    scope = spark.createDataFrame([(1, False), (2, True), (3, False), (4, None)], "y_true int, action boolean")
    return metrics.scoped(predictions(spark, sf), scope, ["y_true"], "action").groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))


@query("efficiency_rates", "select o_orderpriority as name, round(cast(count(*) as double) / sum(o_totalprice), 9) as rows_per_second, round(sum(o_custkey) / 1e6, 3) as megabytes from orders group by 1")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum("o_totalprice").alias("seconds"), F.sum("o_custkey").alias("bytes"))
    return metrics.efficiency(o).select("name", F.round("rows_per_second", 9).alias("rows_per_second"), "megabytes")


@query("likelihood_and_brier", f"""select count(*) as n, round(avg(-ln(least(1.0, greatest(1e-12, probs[y_true + 1])))), 6) as nll, round(avg({' + '.join(f'pow(probs[{j + 1}] - case when y_true = {j} then 1 else 0 end, 2)' for j in LABELS)}), 6) as brier from {PROBS}""")
def _(spark, sf):
    return rounded(calibration.likelihood(with_probs(spark, sf)))


BIN = "(" + " + ".join(f"case when conf > cast({i} as double) / 15 then 1 else 0 end" for i in range(1, 15)) + ")"
BINS = f"(select b, count(*) as n, avg(conf) as c, avg(cast(correct as integer)) as a from (select *, {BIN} as b from {P}) group by 1)"


@query("calibration_bins", f"select cast(i as integer) as bin, coalesce(n, 0) as n, round(c, 6) as confidence, round(a, 6) as accuracy from range(15) r(i) left join {BINS} on i = b")
def _(spark, sf):
    return rounded(calibration.bins(predictions(spark, sf)))


@query("calibration_error", f"select round(sum(abs(a - c) * n) / sum(n), 6) as ece, round(max(abs(a - c)), 6) as mce from {BINS}")
def _(spark, sf):
    return rounded(calibration.calibration_error(calibration.bins(predictions(spark, sf))))


@query("grouped_scores", f"select count(*) as n, round(avg(m), 6) as mean_mass, round(avg((probs[1] + probs[3]) / greatest(m, 1e-12)), 6) as mean_first from (select probs, probs[1] + probs[3] + probs[2] as m from {PROBS})")
def _(spark, sf):
    scores, mass = calibration.group_scores(F.col("probs"), [[0, 2], [1]])
    d = with_probs(spark, sf).select(scores.alias("s"), mass.alias("m"))
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean_mass"), F.avg(F.col("s")[0]).alias("mean_first")))


@query("temperature_fit")
def _(spark, sf):
    rows = Scratch(spark).keep(predictions(spark, sf).select("y_true", "logits"), "logits")
    t = calibration.fit_temperature(rows)
    return spark.createDataFrame([(round(t, 3),)], "temperature double")


RC = f"""(select threshold, n_covered, n_all - n_covered as n_deferred, n_covered / n_all as coverage, s / n_covered as mean from (
select conf as threshold, cast(sum(n) over w as bigint) as n_covered, sum(s) over w as s, sum(n) over () as n_all from (select conf, count(*) as n, sum(cast(correct as integer)) as s from {P} group by 1) window w as (order by conf desc)
union all select 0.0, count(*), sum(cast(correct as integer)), count(*) from {P}))"""


@query("risk_coverage_curve", f"select round(threshold, 6) as threshold, n_covered, cast(n_deferred as bigint) as n_deferred, round(coverage, 6) as coverage, round(mean, 6) as mean from {RC}")
def _(spark, sf):
    return rounded(calibration.risk_coverage(predictions(spark, sf), "correct", Scratch(spark)))


@query("operating_point", f"select round(threshold, 6) as threshold, n_covered, cast(n_deferred as bigint) as n_deferred, round(coverage, 6) as coverage, round(mean, 6) as mean from {RC} where mean >= 0.68 order by coverage desc, threshold limit 1")
def _(spark, sf):
    return rounded(calibration.operating_point(calibration.risk_coverage(predictions(spark, sf), "correct", Scratch(spark)), 0.68))


@query("selective_at_threshold", f"select round(avg(cast(conf >= 0.5 as integer)), 6) as coverage, round(avg(cast(correct as integer)) filter (where conf >= 0.5), 6) as mean from {P}")
def _(spark, sf):
    return rounded(calibration.at_threshold(predictions(spark, sf), 0.5, "correct"))


@query("selective_action_curve", f"""select round(conf, 6) as threshold, cast(sum(n) over w as bigint) as n_covered, cast(sum(n) over () - sum(n) over w as bigint) as n_deferred, round(sum(n) over w / sum(n) over (), 6) as coverage, round(sum(s) over w / sum(n) over w, 6) as mean
from (select conf, count(*) as n, sum(case when ta = pa then 1 else 0 end) as s from {J} where ta is not null group by 1) window w as (order by conf desc)
union all select 0.0, count(*), 0, 1.0, round(avg(case when ta = pa then 1 else 0 end), 6) from {J} where ta is not null""")
def _(spark, sf):
    rows = projected(spark, sf).where("true_action is not null").withColumn("hit", F.coalesce(F.col("true_action") == F.col("pred_action"), F.lit(False)))
    return rounded(calibration.risk_coverage(rows, "hit", Scratch(spark)))


@query("selective_cost_curve", f"""with r as (select conf, c from {J} join {CK} k(x, y, c) on ta = x and pa = y)
select round(conf, 6) as threshold, cast(sum(n) over w as bigint) as n_covered, cast(sum(n) over () - sum(n) over w as bigint) as n_deferred, round(sum(n) over w / sum(n) over (), 6) as coverage, round(sum(s) over w / sum(n) over w, 6) as mean
from (select conf, count(*) as n, sum(c) as s from r group by 1) window w as (order by conf desc) union all select 0.0, count(*), 0, 1.0, round(avg(c), 6) from r""")
def _(spark, sf):
    costs = spark.createDataFrame(COSTS, "true_action string, pred_action string, cost double")
    rows = projected(spark, sf).join(costs, ["true_action", "pred_action"])
    return rounded(calibration.risk_coverage(rows, "cost", Scratch(spark)))


KS = f"(select i as point, greatest(1, cast(round_even((1.0 - (cast(0.95 as double) / 20) * i) * (select count(*) from {P}), 0) as bigint)) as k from range(21) r(i))"
AB = f"(select cast(point as integer) as point, k as n_accepted, k / cast((select count(*) from {P}) as double) as coverage, conf as threshold, h / cast(k as double) as accuracy, 1 - h / cast(k as double) as risk from {KS} join (select conf, row_number() over w as rk, sum(cast(correct as integer)) over (order by conf desc, item_id rows unbounded preceding) as h from {P} window w as (order by conf desc, item_id)) on rk = k)"


@query("abstention_curve", f"select point, n_accepted, round(coverage, 6) as coverage, round(threshold, 6) as threshold, round(accuracy, 6) as accuracy, round(risk, 6) as risk from {AB}")
def _(spark, sf):
    return rounded(calibration.abstention_curve(predictions(spark, sf), Scratch(spark)))


@query("abstention_area", f"select round(sum((coverage - pc) * (risk + pr) / 2) / (max(coverage) - min(coverage)), 6) as area from (select coverage, risk, lag(coverage) over (order by coverage) as pc, lag(risk) over (order by coverage) as pr from {AB})")
def _(spark, sf):
    return rounded(calibration.area_under(calibration.abstention_curve(predictions(spark, sf), Scratch(spark))))


def runs_of(spark, sf, distinct: bool = True):
    """The predictions of three runs; operators that combine repeats themselves spare the pass that removes them."""
    out = None
    for r in range(3):
        p = predictions(spark, sf, r).select(F.lit(f"m{r}").alias("run"), "item_id", "y_true", "y_pred", "correct")
        p = p.distinct() if distinct else p
        out = p if out is None else out.unionAll(p)
    return out


R = "(" + " union all ".join(f"select distinct 'm{r}' as run, item_id, y_true, y_pred, correct from {pred_sql(r)}" for r in range(3)) + ")"
DIS = f"(select a.run as run_a, b.run as run_b, count(*) as n, count(*) filter (where a.correct and not b.correct) as b, count(*) filter (where b.correct and not a.correct) as c from {R} a join {R} b on a.item_id = b.item_id and a.run < b.run group by 1, 2)"
PV = "case when b + c = 0 then 1.0 else least(1.0, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)) for k in range(0, least(b, c) + 1)])) end"


@query("discordant_counts", f"select * from {DIS}")
def _(spark, sf):
    return inference.discordant(runs_of(spark, sf, distinct=False))


@query("mcnemar_exact", f"select run_a, run_b, b, c, round({PV}, 6) as p from {DIS}")
def _(spark, sf):
    d = inference.discordant(runs_of(spark, sf, distinct=False))
    return rounded(d.select("run_a", "run_b", "b", "c", inference.exact_p("b", "c").alias("p")))


DAILY = "(select source, lang, count(*) filter (where doc_id % 3 = 0) as b, count(*) filter (where doc_id % 3 = 1) as c from documents where source is not null and lang is not null group by 1, 2)"


@query("mcnemar_holm", f"select source, lang, b, c, round(p, 6) as p, round(max(s) over (order by p, source, lang rows unbounded preceding), 6) as p_holm from (select *, least(1.0, (count(*) over () - row_number() over (order by p, source, lang) + 1) * p) as s from (select *, round({PV}, 9) as p from {DAILY}))")
def _(spark, sf):
    d = table(spark, sf, "documents").where("source is not null and lang is not null").groupBy("source", "lang").agg(F.count_if(F.col("doc_id") % 3 == 0).alias("b"), F.count_if(F.col("doc_id") % 3 == 1).alias("c"))
    return rounded(inference.holm(d.withColumn("p", F.round(inference.exact_p("b", "c"), 9)), "p", ["source", "lang"], Scratch(spark)))


@query("bca_intervals")
def _(spark, sf):
    return rounded(inference.bca_intervals(metrics.confusion(runs_of(spark, sf), ["run"]), ["run"], 5))


@query("per_run_summary", f"select run, count(*) as n, round(avg(cast(correct as integer)), 6) as accuracy from {R} group by 1")
def _(spark, sf):
    return rounded(metrics.summary(metrics.per_class(metrics.confusion(runs_of(spark, sf), ["run"]), ["run"]), ["run"]).select("run", "n", "accuracy"))


@query("run_pairing_gaps", f"select item_id, count(distinct run) as n_runs, count(distinct y_true) as n_labels from {R} where not (run = 'm2' and item_id % 1000 = 3) group by 1 having count(distinct run) <> 3")
def _(spark, sf):
    return inference.pairing_gaps(runs_of(spark, sf).where("not (run = 'm2' and item_id % 1000 = 3)"), "run", "item_id", "y_true")


T6 = "(select distinct model, trim(regexp_replace(lower(dataset), '\\s+', ' ', 'g')) as ds, setting, seed, nll, brier, ece, mce, aurc, temperature from table6_calibration_per_seed)"


def runs6(spark, sf):
    key = F.trim(F.regexp_replace(F.lower("dataset"), r"\s+", " ")).alias("ds")
    return table(spark, sf, "table6_calibration_per_seed").select("model", key, "setting", "seed", "nll", "brier", "ece", "mce", "aurc", "temperature").distinct()


def _stat(v: str) -> str:
    ok = f"cast({v} as varchar) <> 'nan'"
    return f"round(avg({v}) filter (where {ok}), 6) as {v}_mean, round(stddev_samp({v}) filter (where {ok}), 6) as {v}_sd, count(*) filter (where {ok}) as {v}_n"


@query("seed_rollup", f"select model, ds, setting, {', '.join(map(_stat, ('nll', 'brier', 'ece', 'mce', 'aurc', 'temperature')))} from {T6} group by 1, 2, 3")
def _(spark, sf):
    return rounded(metrics.mean_sd(runs6(spark, sf), ["model", "ds", "setting"], ["nll", "brier", "ece", "mce", "aurc", "temperature"]))


@query("model_rollup", f"select model, {_stat('ece')} from {T6} group by 1")
def _(spark, sf):
    return rounded(metrics.mean_sd(runs6(spark, sf), ["model"], ["ece"]))


S1, S2 = "same site", "other site"
CH = f"(select model, ds, seed, base, other, other - base as change, case when base <> 0 then (other - base) / base end as relative from (select model, ds, seed, max(ece) filter (where setting = '{S1}' and cast(ece as varchar) <> 'nan') as base, max(ece) filter (where setting = '{S2}' and cast(ece as varchar) <> 'nan') as other from {T6} group by 1, 2, 3) where base is not null and other is not null)"


def changes(spark, sf):
    return inference.paired_change(runs6(spark, sf).where("not isnan(ece)"), ["model", "ds", "seed"], "setting", S1, S2, "ece")


@query("paired_degradation", f"select model, ds, seed, round(base, 6) as base, round(other, 6) as other, round(change, 6) as change, round(relative, 6) as relative from {CH}")
def _(spark, sf):
    return rounded(changes(spark, sf))


@query("degradation_rollup", f"select model, round(avg(change), 6) as change_mean, round(stddev_samp(change), 6) as change_sd, count(change) as change_n from {CH} group by 1")
def _(spark, sf):
    return rounded(metrics.mean_sd(changes(spark, sf), ["model"], ["change"]))


@query("cross_seed_consistency", f"select model, ds, count(change) as n, count(*) filter (where change > 0) as n_up, count(*) filter (where change < 0) as n_down, round(avg(change), 6) as mean_change, case when count(*) filter (where change > 0) = count(*) then 'always up' when count(*) filter (where change < 0) = count(*) then 'always down' else 'mixed' end as verdict from {CH} group by 1, 2")
def _(spark, sf):
    return rounded(inference.consistency(changes(spark, sf), ["model", "ds"], "change"))


BYMODEL = f"(select ds || '#' || setting as cell, model, round(avg(ece) filter (where cast(ece as varchar) <> 'nan'), 9) as v from {T6} group by 1, 2)"
RANKED = f"(select cell, model, row_number() over (partition by cell order by v, model) as rank from {BYMODEL} where v is not null)"


def _cells(spark, sf):
    ok = F.when(~F.isnan("ece"), F.col("ece"))
    return runs6(spark, sf).where("ds is not null and setting is not null").groupBy(F.concat_ws("#", "ds", "setting").alias("cell"), "model").agg(F.round(F.avg(ok), 9).alias("v"))


@query("model_rankings", f"select cell, model, rank from {RANKED} where cell is not null")
def _(spark, sf):
    return inference.rankings(_cells(spark, sf), "cell", "model", "v", descending=False)


@query("ranking_stability", f"select cast(sum(c) as bigint) as n_seeds, count(*) as n_orders, arg_min(o, (-c, o)) as modal_order, max(c) as n_modal, case when count(*) = 1 then 'STABLE' else 'UNSTABLE' end as state from (select o, count(*) as c from (select cell, string_agg(model, '>' order by rank) as o from {RANKED} where cell is not null group by 1) group by 1)")
def _(spark, sf):
    return inference.ranking_stability(inference.rankings(_cells(spark, sf), "cell", "model", "v", descending=False), "cell", "model")


MS = f"(select model, avg(ece) filter (where cast(ece as varchar) <> 'nan') as m, stddev_samp(ece) filter (where cast(ece as varchar) <> 'nan') as s from {T6} where model is not null group by 1)"


@query("pairwise_margins", f"select a.model as model_a, b.model as model_b, round(a.m - b.m, 6) as margin, round(sqrt((pow(a.s, 2) + pow(b.s, 2)) / 2), 6) as pooled_sd, round(abs(a.m - b.m) / sqrt((pow(a.s, 2) + pow(b.s, 2)) / 2), 6) as ratio from {MS} a join {MS} b on a.model < b.model")
def _(spark, sf):
    s = metrics.mean_sd(runs6(spark, sf).where("model is not null"), ["model"], ["ece"]).select("model", F.col("ece_mean").alias("mean"), F.col("ece_sd").alias("sd"))
    return rounded(inference.margins(s, "model"))


@query("complete_cells", f"select ds, count(distinct (model, setting)) as n_cells from {T6} where model is not null and setting is not null and ds is not null group by 1 having count(distinct (model, setting)) = 12")
def _(spark, sf):
    return inference.complete_seeds(runs6(spark, sf).where("model is not null and setting is not null and ds is not null"), "ds", ["model", "setting"], 12)


@query("calibration_pivot", f"select model, round(avg(ece) filter (where setting = '{S1}' and cast(ece as varchar) <> 'nan'), 6) as same_site, round(avg(ece) filter (where setting = '{S2}' and cast(ece as varchar) <> 'nan'), 6) as other_site from {T6} group by 1")
def _(spark, sf):
    ok = F.when(~F.isnan("ece"), F.col("ece"))
    wide = runs6(spark, sf).groupBy("model").pivot("setting", [S1, S2]).agg(F.avg(ok))
    return rounded(wide.withColumnsRenamed({S1: "same_site", S2: "other_site"}))


RX = "(select l_quantity as x, l_extendedprice as y from lineitem)"


@query("spearman_rank", f"select round(corr(rx, ry), 6) as rho, count(*) as n from (select rank() over (order by x) + (count(*) over (partition by x) - 1) / cast(2 as double) as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / cast(2 as double) as ry from {RX})")
def _(spark, sf):
    return rounded(inference.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", Scratch(spark)))


@query("tolerance_breaks", "select o_orderkey, o_totalprice as value_a, o_totalprice + 1 as value_b from orders where o_orderkey % 997 = 5")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    changed = o.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 997 == 5, 1.0).otherwise(1e-12))
    return inference.tolerance_breaks(o, changed, ["o_orderkey"], "o_totalprice", 1e-6)


@query("reliability_rows", f"select cast(b as integer) as bin, n, round(c, 6) as confidence, round(a, 6) as accuracy from {BINS}")
def _(spark, sf):
    return rounded(calibration.bins(predictions(spark, sf)).where("n > 0"))
