"""Inference on results: exact McNemar tests, Holm's correction, bootstrap intervals, consistency over seeds.

The inputs here are run tables (few rows per model and seed) or counts; windows over whole families are small by nature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mullion.scale import Scratch, running_sums


def _beta_tail(a: float, b: float) -> float:
    """The regularised incomplete beta at 1/2 for a >= b - 1, by its continued fraction."""
    tiny, x = 1e-300, 0.5
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1_000_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + step * d, 1.0 + step / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b) - (a + b) * math.log(2))


@F.pandas_udf(T.DoubleType())
def exact_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact binomial p of discordant counts; 1 if there are none. Time and memory don't grow with the counts
    but for the fraction's terms, some root of them."""

    def one(x: int, y: int) -> float:
        return 1.0 if x == y else min(1.0, 2 * _beta_tail(max(x, y), min(x, y) + 1))

    return pd.Series([one(int(x), int(y)) for x, y in zip(b, c)])


def discordant(pred: DataFrame, run: str = "run", item: str = "item_id", correct: str = "correct") -> DataFrame:
    """(run_a, run_b, n, b, c) for every two runs a < b over their common items: b counts items that only a has right.

    Each item's runs are one sorted pattern (an item has a row per run, few of them; repeats count once); patterns are
    counted before they are taken apart into pairs, so that items are shuffled once and nothing is joined.
    """
    once = pred.where(F.col(correct).isNotNull()).groupBy(item, run).agg(F.max(F.col(correct).cast("int")).alias("_c"))
    patterns = once.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col("_c").alias("c")))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    pairs = patterns.select("n", "p", F.posexplode("p").alias("i", "x")).select("n", "x", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("y"))
    only = lambda x, y: F.coalesce(F.sum(F.when((F.col(x) == 1) & (F.col(y) == 0), F.col("n"))), F.lit(0))
    return pairs.groupBy(F.col("x.r").alias("run_a"), F.col("y.r").alias("run_b")).agg(F.sum("n").alias("n"), only("x.c", "y.c").alias("b"), only("y.c", "x.c").alias("c"))


def holm(tests: DataFrame, p: str, order: Sequence[str], scratch: Scratch, name: str = "p_holm") -> DataFrame:
    """Adds Holm's step-down p over the whole table; ties keep the given order. Ranks and the running maximum are taken
    by ranges, so that any number of tests does."""
    held, m = scratch.keep_counted(tests, "tests")[:2]
    ranked = running_sums(held, [F.col(p), *[F.col(c) for c in order]], {"_rank": F.lit(1).cast("long")}, scratch)
    stepped = ranked.withColumn("_s", F.least(F.lit(1.0), (F.lit(m) - F.col("_rank") + 1) * F.col(p)))
    return running_sums(stepped, [F.col("_rank")], {name: F.col("_s")}, scratch, fold=F.max).drop("_s", "_rank")


def paired_change(runs: DataFrame, keys: Sequence[str], setting: str, base: str, other: str, value: str) -> DataFrame:
    """(keys, base, other, change, relative) of a value between two settings within the same keys; relative is null at 0."""
    wide = runs.groupBy(*keys).agg(F.max(F.when(F.col(setting) == base, F.col(value))).alias("base"), F.max(F.when(F.col(setting) == other, F.col(value))).alias("other"))
    both = wide.where("base is not null and other is not null")
    return both.select(*keys, "base", "other", (F.col("other") - F.col("base")).alias("change"), F.try_divide(F.col("other") - F.col("base"), F.nullif("base", F.lit(0.0))).alias("relative"))


def rankings(runs: DataFrame, seed: str, model: str, value: str, descending: bool = True) -> DataFrame:
    """(seed, model, rank): models ranked within each seed, ties by name."""
    w = Window.partitionBy(seed).orderBy(F.desc(value) if descending else F.asc(value), model)
    return runs.where(F.col(value).isNotNull()).select(seed, model, F.row_number().over(w).cast("long").alias("rank"))


def ranking_stability(ranked: DataFrame, seed: str, model: str) -> DataFrame:
    """One row: seeds, different orders, the commonest order (ties by text), how often, and STABLE or UNSTABLE."""
    orders = ranked.groupBy(seed).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", model))), lambda x: x[model]), ">").alias("o"))
    by = orders.groupBy("o").agg(F.count(F.lit(1)).alias("c"))
    one = by.agg(F.sum("c").alias("n_seeds"), F.count(F.lit(1)).alias("n_orders"), F.min_by("o", F.struct(-F.col("c"), F.col("o"))).alias("modal_order"), F.max("c").alias("n_modal"))
    return one.withColumn("state", F.when(F.col("n_orders") == 1, "STABLE").otherwise("UNSTABLE"))


def margins(stats: DataFrame, model: str) -> DataFrame:
    """(model_a, model_b, margin, pooled_sd, ratio) of every two models' (mean, sd), a < b by name."""
    a = stats.select(F.col(model).alias("model_a"), F.col("mean").alias("ma"), F.col("sd").alias("sa"), F.lit(1).alias("k"))
    b = stats.select(F.col(model).alias("model_b"), F.col("mean").alias("mb"), F.col("sd").alias("sb"), F.lit(1).alias("k"))
    pooled = F.sqrt((F.pow("sa", 2) + F.pow("sb", 2)) / 2)
    m = F.col("ma") - F.col("mb")
    return a.join(b, "k").where("model_a < model_b").select("model_a", "model_b", m.alias("margin"), pooled.alias("pooled_sd"), F.try_divide(F.abs(m), pooled).alias("ratio"))


def consistency(diffs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per key over seeds: number, how many differences are positive or negative, their mean, and a verdict."""
    one = diffs.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.col(value) > 0).alias("n_up"), F.count_if(F.col(value) < 0).alias("n_down"), F.avg(value).alias("mean_change"))
    verdict = F.when(F.col("n") == 0, "none").when(F.col("n_up") == F.col("n"), "always up").when(F.col("n_down") == F.col("n"), "always down").otherwise("mixed")
    return one.withColumn("verdict", verdict)


def spearman(df: DataFrame, x: str, y: str, scratch: Scratch) -> DataFrame:
    """One row: the correlation of average ranks and the number of rows; rows with a null on either side are left out.

    Ranks come from counts per value and running sums over ranges, so neither ties nor many values need one task.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))

    def ranks(c: str, name: str) -> DataFrame:
        by = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        return running_sums(by, [F.asc(c)], {"upto": F.col("n")}, scratch).select(c, (F.col("upto") - (F.col("n") - 1) / 2).alias(name))

    return rows.join(ranks("_x", "_rx"), "_x").join(ranks("_y", "_ry"), "_y").agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def pairing_gaps(pred: DataFrame, run: str, item: str, label: str) -> DataFrame:
    """Items that don't have the same true label in every run: the runs of such a table must not be paired."""
    n_runs = pred.agg(F.count_distinct(run)).head()[0]
    return pred.groupBy(item).agg(F.count_distinct(run).alias("n_runs"), F.count_distinct(label).alias("n_labels")).where((F.col("n_runs") != n_runs) | (F.col("n_labels") != 1))


def complete_seeds(runs: DataFrame, seed: str, cell: Sequence[str], wanted: int) -> DataFrame:
    """Seeds that have all of the wanted number of cells: relational division."""
    return runs.groupBy(seed).agg(F.count_distinct(*cell).alias("n_cells")).where(F.col("n_cells") == wanted)


def _stats(tables: np.ndarray, which: str) -> np.ndarray:
    """Accuracy or macro F1 of many confusion tables (draws, k, k)."""
    hit = np.diagonal(tables, axis1=1, axis2=2).astype(float)
    if which == "accuracy":
        return hit.sum(1) / tables.sum((1, 2))
    support, predicted = tables.sum(2), tables.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        f1 = np.where(support + predicted > 0, 2 * hit / (support + predicted), 0.0)
    has = support > 0
    return (f1 * has).sum(1) / np.maximum(has.sum(1), 1)


def bca_intervals(cells: DataFrame, by: Sequence[str], k: int, draws: int = 10_000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(by, statistic, estimate, low, high, method) by the bias-corrected accelerated bootstrap over confusion cells.

    cells: (by, y_true, y_pred, n), at most k squared rows per key, whatever the number of items. Drawing cells from a
    multinomial is drawing items; the jackknife has one term per cell, weighted by its count. Draws are seeded by the
    key, so a run is repeatable. Where the correction is undefined the percentile interval is given and named so.
    """
    import zlib

    names = list(by)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((k, k))
        table[rows["y_true"].to_numpy(), rows["y_pred"].to_numpy()] = rows["n"].to_numpy()
        n = int(table.sum())
        rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
        drawn = rng.multinomial(n, (table / n).ravel(), size=draws).reshape(-1, k, k)
        out = []
        normal = NormalDist()
        for which in ("accuracy", "macro_f1"):
            est = float(_stats(table[None], which)[0])
            boot = _stats(drawn, which)
            below = ((boot < est).sum() + 0.5 * (boot == est).sum()) / draws
            cells_at = np.argwhere(table > 0)
            less = np.repeat(table[None], len(cells_at), 0)
            less[np.arange(len(cells_at)), cells_at[:, 0], cells_at[:, 1]] -= 1
            weight = table[cells_at[:, 0], cells_at[:, 1]]
            jack = _stats(less, which)
            d = (jack * weight).sum() / n - jack
            spread = (weight * d**2).sum() ** 1.5
            a = float((weight * d**3).sum() / (6 * spread)) if spread > 0 else float("nan")
            tail = (1 - level) / 2
            if 0 < below < 1 and math.isfinite(a):
                z0 = normal.inv_cdf(float(below))
                ends = [normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (normal.inv_cdf(tail), normal.inv_cdf(1 - tail))]
                method = "bca"
            else:
                ends, method = [tail, 1 - tail], "percentile"
            lo, hi = np.quantile(boot, ends)
            out.append((*key, which, est, float(lo), float(hi), method))
        return pd.DataFrame(out, columns=[*names, "statistic", "estimate", "low", "high", "method"])

    kinds = ", ".join(f"{c} {t}" for c, t in cells.dtypes if c in names)
    return cells.groupBy(*names).applyInPandas(run, f"{kinds}, statistic string, estimate double, low double, high double, method string")


def tolerance_breaks(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose value differs by more than a tolerance between two tables, or stands in one of them only."""
    j = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib")), list(keys), "full")
    same = F.col("_a").eqNullSafe(F.col("_b")) | (F.abs(F.col("_a") - F.col("_b")) <= tolerance)
    return j.where(F.col("_ia").isNull() | F.col("_ib").isNull() | ~F.coalesce(same, F.lit(False))).select(*keys, F.col("_a").alias("value_a"), F.col("_b").alias("value_b"))


