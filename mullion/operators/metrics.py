"""Classification metrics over prediction tables: everything from one confusion table of at most k squared rows.

Predictions have y_true and y_pred (int) and may have action or score columns; further key columns (a run, a model) may
be given as `by`. Rows with a null label on either side are left out of accuracies but counted where a count says so.
Zero denominators give 0 for precision, recall and F1, and null for means over nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, y_true, y_pred, n) for the pairs that occur."""
    return pred.where("y_true is not null and y_pred is not null").groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def dense_confusion(pred: DataFrame, labels: Sequence[int]) -> DataFrame:
    """One row per label with a column of counts per predicted label, zero where there are none."""
    cells = confusion(pred)
    dim = pred.sparkSession.createDataFrame([(x,) for x in labels], "y_true int")
    wide = cells.groupBy("y_true").agg(*[F.coalesce(F.sum(F.when(F.col("y_pred") == x, F.col("n"))), F.lit(0)).alias(f"pred_{x}") for x in labels])
    return dim.join(wide, "y_true", "left").select("y_true", *[F.coalesce(f"pred_{x}", F.lit(0)).alias(f"pred_{x}") for x in labels])


def normalised_confusion(pred: DataFrame) -> DataFrame:
    """(y_true, y_pred, share): each true label's row sums to 1."""
    return confusion(pred).select("y_true", "y_pred", (F.col("n") / F.sum("n").over(Window.partitionBy("y_true"))).alias("share"))


def per_class(cells: DataFrame, by: Sequence[str] = (), labels: Sequence[int] | None = None) -> DataFrame:
    """(by, label, support, precision, recall, f1) from confusion cells; labels that never occur come in by `labels`."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), hit.cast("long").alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    rows = cells.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    if labels is not None and not by:
        rows = rows.unionByName(cells.sparkSession.createDataFrame([(x, 0, 0, 0) for x in labels], "label int, tp long, support long, predicted long"))
    t = rows.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return t.select(*by, "label", "tp", "support", "predicted", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def summary(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted scores over the labels that have rows, macro F1 over all labels, balanced accuracy."""
    has = F.col("support") > 0
    return classes.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(has, F.col("precision"))).alias("macro_precision"),
        F.avg(F.when(has, F.col("recall"))).alias("macro_recall"),
        F.avg(F.when(has, F.col("f1"))).alias("macro_f1"),
        F.avg("f1").alias("macro_f1_all"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(has, F.col("recall"))).alias("balanced_accuracy"),
        F.sum(F.when(~has, F.col("predicted")).otherwise(0)).alias("predicted_without_support"),
    )


def top1(pred: DataFrame) -> DataFrame:
    """One row: accuracy; null for an empty table."""
    return pred.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def project(pred: DataFrame, lookup: DataFrame, key: str = "label", value: str = "action") -> DataFrame:
    """Adds true_action and pred_action by a lookup of unique labels; labels without a row are unmapped: null.

    The lookup is a table of the label vocabulary; it is broadcast by the optimiser where its size allows.
    """
    t = lookup.select(F.col(key).alias("_t"), F.col(value).alias("true_action"))
    p = lookup.select(F.col(key).alias("_p"), F.col(value).alias("pred_action"))
    return pred.join(t, F.col("y_true") == F.col("_t"), "left").join(p, F.col("y_pred") == F.col("_p"), "left").drop("_t", "_p")


def unique_lookup(lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a lookup has more than once, which makes it none."""
    return lookup.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def action_accuracy(projected: DataFrame, unmapped_pred: str = "incorrect") -> DataFrame:
    """One row of counters and the accuracy over mapped true actions.

    unmapped_pred: 'incorrect' counts an unmapped prediction as wrong, 'exclude' leaves its row out. Rows with an
    unmapped true label are always left out; included and excluded sum to the total.
    """
    if unmapped_pred not in ("incorrect", "exclude"):
        raise ValueError("unmapped_pred must be incorrect or exclude")
    t, p = F.col("true_action"), F.col("pred_action")
    taken = t.isNotNull() & (p.isNotNull() if unmapped_pred == "exclude" else F.lit(True))
    right = F.coalesce(taken & (t == p), F.lit(False))
    one = projected.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(taken).alias("n_included"),
        F.count_if(right).alias("n_correct"),
        F.count_if(t.isNull()).alias("n_unmapped_true"),
        F.count_if(t.isNotNull() & p.isNull()).alias("n_unmapped_pred"),
    )
    return one.withColumn("n_excluded", F.col("n_total") - F.col("n_included")).withColumn("accuracy", F.try_divide(F.col("n_correct"), F.col("n_included")))


def action_counts(projected: DataFrame, side: str = "true_action") -> DataFrame:
    return projected.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def action_majority(projected: DataFrame) -> DataFrame:
    """One row: the commonest true action, ties by name, and the accuracy of always giving it."""
    by = action_counts(projected)
    return by.agg(F.min_by("action", F.struct(-F.col("n"), F.col("action"))).alias("action"), (F.max("n") / F.sum("n")).alias("accuracy"))


def action_confusion(projected: DataFrame, actions: Sequence[str]) -> DataFrame:
    """One row per true action with counts per predicted action and for unmapped predictions, zero-filled."""
    pred = F.coalesce("pred_action", F.lit("unmapped"))
    wide = projected.where("true_action is not null").groupBy("true_action").agg(*[F.count_if(pred == a).alias(f"pred_{a}") for a in [*actions, "unmapped"]])
    dim = projected.sparkSession.createDataFrame([(a,) for a in actions], "true_action string")
    return dim.join(wide, "true_action", "left").select("true_action", *[F.coalesce(f"pred_{a}", F.lit(0)).alias(f"pred_{a}") for a in [*actions, "unmapped"]])


def action_report(projected: DataFrame) -> DataFrame:
    """One row: label accuracy, action accuracy, and what collapsing labels to actions adds."""
    t, p = F.col("true_action"), F.col("pred_action")
    one = projected.agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("label_accuracy"),
        F.try_divide(F.count_if(t == p), F.count_if(t.isNotNull())).alias("action_accuracy"),
    )
    return one.withColumn("gain", F.round(F.col("action_accuracy") - F.col("label_accuracy"), 6))


def mean_cost(projected: DataFrame, costs: DataFrame, unmapped_pred_cost: float | None = None) -> DataFrame:
    """One row: the mean cost[true_action, pred_action] over the rows included.

    An unmapped true label is left out; an unmapped prediction too, unless a cost for it is given. A pair of actions
    that the cost table lacks makes n_without_cost positive and is not averaged.
    """
    c = costs.select(F.col("true_action").alias("_t"), F.col("pred_action").alias("_p"), "cost")
    rows = projected.join(c, (F.col("true_action") == F.col("_t")) & (F.col("pred_action") == F.col("_p")), "left")
    t, p = F.col("true_action").isNotNull(), F.col("pred_action").isNotNull()
    cost = F.when(t & p, F.col("cost"))
    if unmapped_pred_cost is not None:
        cost = F.when(t & ~p, F.lit(float(unmapped_pred_cost))).otherwise(cost)
    return rows.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(cost).alias("n_included"),
        F.count_if(~t).alias("n_unmapped_true"),
        F.count_if(t & ~p).alias("n_unmapped_pred"),
        F.count_if(t & p & F.col("cost").isNull()).alias("n_without_cost"),
        F.avg(cost).alias("mean_cost"),
    )


def cost_gaps(costs: DataFrame, actions: Sequence[str]) -> DataFrame:
    """What is wrong with a cost table: (true_action, pred_action, problem) for missing cells, negative costs and a
    diagonal that isn't zero."""
    grid = costs.sparkSession.createDataFrame([(a, b) for a in actions for b in actions], "true_action string, pred_action string")
    j = grid.join(costs.select("true_action", "pred_action", "cost"), ["true_action", "pred_action"], "left")
    problem = F.when(F.col("cost").isNull(), "missing").when(F.col("cost") < 0, "negative").when((F.col("true_action") == F.col("pred_action")) & (F.col("cost") != 0), "diagonal")
    return j.select("true_action", "pred_action", problem.alias("problem")).where("problem is not null")


def scoped(rows: DataFrame, scope: DataFrame, keys: Sequence[str], layer: str) -> DataFrame:
    """Rows whose keys the scope does not switch off for a layer; keys that the scope lacks are in."""
    off = scope.where(~F.coalesce(F.col(layer), F.lit(True))).select(*keys).distinct()
    return rows.join(off, list(keys), "left_anti")


def efficiency(df: DataFrame) -> DataFrame:
    """Adds rates to rows of (seconds, rows, bytes): rows a second and megabytes, null for no time."""
    return df.select("*", F.try_divide(F.col("rows"), F.col("seconds")).alias("rows_per_second"), F.round(F.col("bytes") / 1e6, 3).alias("megabytes"))


def mean_sd(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, sample standard deviation (null for one value) and number of the values that are neither null nor NaN."""
    out = []
    for v in values:
        c = F.when(~F.isnan(F.col(v)), F.col(v))
        out += [F.avg(c).alias(f"{v}_mean"), F.stddev_samp(c).alias(f"{v}_sd"), F.count(c).alias(f"{v}_n")]
    return df.groupBy(*by).agg(*out)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of an array of logits, shifted by their largest."""
    t = F.lit(float(temperature)) if not isinstance(temperature, Column) else temperature
    shifted = F.transform(F.array(F.array_max(logits)), lambda top: F.transform(logits, lambda x: F.exp((x - top) / t)))[0]
    # The sum is a variable of the finishing step, not an expression that every element would evaluate anew.
    return F.transform(F.array(shifted), lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x, lambda total: F.transform(e, lambda x: x / total)))[0]


def linear_logits(features: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """The logits of a linear model per class, of an array of features; null for null features or another length.

    Stored weights are applied in the plan itself, so that scoring needs no Python.
    """
    if not weights or len(weights) != len(bias) or len({len(w) for w in weights}) != 1:
        raise ValueError("one bias and equally many weights per class are needed")
    score = lambda w, b: F.aggregate(F.zip_with(features, F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x * y), F.lit(float(b)), lambda s, v: s + v)
    return F.when(F.size(features) == len(weights[0]), F.array(*[score(w, b) for w, b in zip(weights, bias)]))


def first_best(scores: Column) -> Column:
    """The 0-based place of the largest score, the first of equal ones; null for no scores."""
    return F.nullif(F.array_position(scores, F.array_max(scores)) - 1, F.lit(-1)).cast("int")
