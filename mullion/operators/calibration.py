"""Probabilistic metrics: likelihood, Brier score, calibration bins, temperature, and curves over confidence."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mullion.scale import Scratch, running_sums


def nll(y: Column, probs: Column, eps: float = 1e-12) -> Column:
    """Minus the log of the true label's probability, kept within eps and 1; an aggregate's input."""
    return -F.ln(F.least(F.lit(1.0), F.greatest(F.lit(eps), F.element_at(probs, y + 1))))


def brier(y: Column, probs: Column) -> Column:
    """Sum of squared differences from the true label's unit vector."""
    squares = F.aggregate(probs, F.lit(0.0), lambda s, p: s + p * p)
    return squares - 2 * F.element_at(probs, y + 1) + 1


def likelihood(pred: DataFrame) -> DataFrame:
    """One row: n, mean negative log likelihood and mean Brier score of (y_true, probs); nulls are left out."""
    rows = pred.where("y_true is not null and probs is not null")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(nll(F.col("y_true"), F.col("probs"))).alias("nll"), F.avg(brier(F.col("y_true"), F.col("probs"))).alias("brier"))


def edges(n_bins: int) -> list[float]:
    """Inner edges of equal bins of (0, 1]."""
    return [i / n_bins for i in range(1, n_bins)]


def bin_of(conf: Column, n_bins: int) -> Column:
    """The right-closed bin of a confidence; the first bin takes 0 too."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges(n_bins)]), lambda e: conf > e))


def bins(pred: DataFrame, n_bins: int = 15) -> DataFrame:
    """(bin, n, confidence, accuracy) of all bins; empty ones have null means. pred: conf double, correct boolean."""
    found = pred.where("conf is not null and correct is not null").groupBy(bin_of(F.col("conf"), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.avg("conf").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )
    dim = pred.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return dim.join(found, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"), "confidence", "accuracy")


def calibration_error(bin_rows: DataFrame) -> DataFrame:
    """One row: expected and largest calibration error over non-empty bins."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return bin_rows.where("n > 0").agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def group_scores(probs: Column, groups: Sequence[Sequence[int]]) -> tuple[Column, Column]:
    """Scores summed by group of class positions and scaled to 1, and the mass that the groups hold.

    The mass is floored at 1e-12 as a divisor. Classes in no group are dropped from the scores.
    """
    sums = F.array(*[sum((F.element_at(probs, i + 1) for i in g), F.lit(0.0)) for g in groups])
    mass = F.aggregate(sums, F.lit(0.0), lambda s, x: s + x)
    return F.transform(sums, lambda x: x / F.greatest(mass, F.lit(1e-12))), mass


def temperature_losses(pred: DataFrame, temperatures: Sequence[float]) -> list[tuple[float, float]]:
    """(temperature, mean likelihood loss) of (y_true, logits) at each of the temperatures, in one pass over the table.

    Rows without a label are left out; without any others it raises.
    """
    top = F.array_max("logits")
    rows = pred.where("y_true is not null").select(F.transform(F.array(top), lambda m: F.transform("logits", lambda x: x - m))[0].alias("d"), "y_true").select("d", F.element_at("d", F.col("y_true") + 1).alias("own"))
    loss = rows.agg(*[F.avg(F.ln(F.aggregate("d", F.lit(0.0), (lambda t: lambda s, x: s + F.exp(x / F.lit(t)))(float(t)))) - F.col("own") / F.lit(float(t))).alias(f"t{i}") for i, t in enumerate(temperatures)]).head()
    values = [loss[f"t{i}"] for i in range(len(temperatures))]
    if any(v is None or math.isnan(v) for v in values):
        raise ValueError("no rows to fit on")
    return [(float(t), v) for t, v in zip(temperatures, values)]


def fit_temperature(pred: DataFrame, rounds: int = 4, low: float = 0.05, high: float = 20.0, points: int = 17) -> float:
    """The temperature of least mean likelihood loss of (y_true, logits), by grids that narrow around the best point.

    Each round is one aggregate over the table for all points of its grid, so rounds, not points, read the data.
    """
    for _ in range(rounds):
        grid = [low * (high / low) ** (i / (points - 1)) for i in range(points)]
        values = [x for _, x in temperature_losses(pred, grid)]
        k = min(range(points), key=values.__getitem__)
        low, high = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    return math.sqrt(low * high)


def risk_coverage(pred: DataFrame, value: str, scratch: Scratch) -> DataFrame:
    """(threshold, n_covered, n_deferred, coverage, mean) for every distinct confidence and for 0.

    A row is covered if its confidence is at least the threshold; mean is that of `value` over the covered rows. Rows
    are combined by confidence first; the sums run from the highest one down over ranges, not in one task.
    """
    rows = pred.where("conf is not null").select("conf", F.col(value).cast("double").alias("v"))
    by = rows.groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).head()
    n = whole.n
    run = running_sums(by, [F.desc("conf")], {"n_covered": F.col("n"), "total": F.coalesce("s", F.lit(0.0))}, scratch)
    curve = run.select(F.col("conf").alias("threshold"), "n_covered", "total")
    zero = pred.sparkSession.createDataFrame([(0.0, n, whole.s)], "threshold double, n_covered long, total double")
    curve = curve.where("threshold <> 0.0").unionByName(zero)
    covered = F.col("n_covered")
    return curve.select("threshold", "n_covered", (F.lit(n) - covered).alias("n_deferred"), F.try_divide(covered, F.lit(n)).alias("coverage"), F.try_divide(F.col("total"), covered).alias("mean"))


def operating_point(curve: DataFrame, least: float) -> DataFrame:
    """The row of largest coverage whose mean is at least `least`; ties go to the lower threshold. Empty if none is."""
    return curve.where(F.col("mean") >= least).orderBy(F.desc("coverage"), "threshold").limit(1)


def at_threshold(pred: DataFrame, tau: float, value: str) -> DataFrame:
    """One row: coverage at a threshold (0 for an empty table) and the mean over covered rows (null if there are none)."""
    on = F.col("conf") >= tau
    return pred.agg(F.coalesce(F.avg(on.cast("double")), F.lit(0.0)).alias("coverage"), F.avg(F.when(on, F.col(value).cast("double"))).alias("mean"))


def abstention_curve(pred: DataFrame, scratch: Scratch, n_points: int = 21) -> DataFrame:
    """(point, n_accepted, coverage, threshold, accuracy, risk): the most confident rows at even shares from 1 to 0.05.

    pred: item_id, conf, correct. Shares round half to even; ties of confidence go by item_id.
    """
    n = pred.count()
    if not n:
        return pred.sparkSession.createDataFrame([], "point int, n_accepted long, coverage double, threshold double, accuracy double, risk double")
    step = (1.0 - 0.05) / (n_points - 1)
    ks = [max(1, int(round((1.0 - step * i) * n))) for i in range(n_points)]
    points = pred.sparkSession.createDataFrame(list(enumerate(ks)), "point int, k long")
    rows = pred.select("item_id", "conf", F.col("correct").cast("long").alias("c"))
    run = running_sums(rows, [F.desc("conf"), F.asc("item_id")], {"rank": F.lit(1).cast("long"), "hits": F.col("c")}, scratch)
    j = run.join(F.broadcast(points), F.col("rank") == F.col("k"))
    acc = F.col("hits") / F.col("k")
    return j.select("point", F.col("k").alias("n_accepted"), (F.col("k") / n).alias("coverage"), F.col("conf").alias("threshold"), acc.alias("accuracy"), (1.0 - acc).alias("risk"))


def area_under(curve: DataFrame, x: str = "coverage", y: str = "risk") -> DataFrame:
    """One row: the trapezoid area under a curve of few points, divided by its width; null for no width."""
    pts = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    one = curve.agg(pts.alias("p"))
    area = F.aggregate(F.sequence(F.lit(1), F.size("p") - 1), F.lit(0.0), lambda s, i: s + (F.col("p")[i]["x"] - F.col("p")[i - 1]["x"]) * (F.col("p")[i]["y"] + F.col("p")[i - 1]["y"]) / 2)
    width = F.element_at("p", -1)["x"] - F.col("p")[0]["x"]
    return one.select(F.when(F.size("p") > 1, F.try_divide(area, width)).alias("area"))


def interpolated(curves: DataFrame, by: str, x: str, y: str, grid: int = 96) -> DataFrame:
    """(by, point, x, y): each key's curve of few points, linearly between them, at the shares 1/grid to 1.

    Each segment of a curve gives the grid points that lie in it (from its start, up to and without its end, the last
    one with it); no grid is joined with ranges. Points outside a curve have no rows.
    """
    w = Window.partitionBy(by).orderBy(x)
    pts = curves.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by, x).agg(F.avg(y).alias(y))
    seg = pts.select(by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.lead(x, 2).over(w).isNull().alias("last")).where("x1 is not null")
    first = F.greatest(F.ceil(F.col("x0") * grid), F.lit(1))
    end = F.col("x1") * grid
    upto = F.least(F.when(F.col("last"), F.floor(end)).otherwise(F.ceil(end) - 1), F.lit(grid))
    rows = seg.where(first <= upto).select("*", F.explode(F.sequence(first, upto)).alias("point"))
    at = F.col("point") / grid
    return rows.select(by, F.col("point").cast("int").alias("point"), at.alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0"))).alias("y"))


def tiers(value: Column, edges_: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the right-closed bin of a value between rising edges; the first bin has its lower edge too."""
    if len(edges_) != len(names) + 1 or list(edges_) != sorted(edges_):
        raise ValueError("one more edge than names, rising")
    out = F.lit(None).cast("string")
    for name, hi in reversed(list(zip(names, edges_[1:]))):
        out = F.when(value <= hi, name).otherwise(out)
    return F.when(value >= edges_[0], out)
