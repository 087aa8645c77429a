"""Helpers that keep a plan sound when the data no longer fits anywhere: scratch tables, checked broadcasts, ranks.

Nothing here looks at the data's content; every helper behaves alike at every size.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task of a range or a block is meant for.
TASK_ROWS = 1_000_000
#: Ranges at most, so that their totals fit in a broadcast and one small window.
MOST_PARTS = 100_000
#: A side is broadcast only if it is known to have no more rows than this.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster a folder that all executors share is needed")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mullion-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut the lineage and survive a lost executor.

    Tables are removed by drop() once nothing reads them any more, the rest when the driver ends; used as a context, at
    its end, for results that are written within it.
    """

    #: Folders that are still there, removed when the driver ends.
    _open: set[Scratch] = set()

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/mullion-{uuid.uuid4().hex}"
        Scratch._open.add(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop_all()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back."""
        return self.keep_counted(df, name)[0]

    def keep_counted(self, df: DataFrame, name: str, *more: Column) -> tuple[DataFrame, int, *tuple]:
        """keep(), the number of rows, and further aggregates over them, all of which the write counts as it goes."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        marked = df.observe(seen, F.count(F.lit(1)).alias("_n"), *[c.alias(f"_m{i}") for i, c in enumerate(more)])
        marked.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._mullion_path = path
        values = seen.get
        if "_n" not in values:
            # A plan that is known to be empty is not run, so nothing was counted.
            values = out.agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_m{i}") for i, c in enumerate(more)]).head().asDict()
        return out, values["_n"], *[values[f"_m{i}"] for i in range(len(more))]

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if path := getattr(t, "_mullion_path", None):
                self._delete(path)

    def drop_all(self) -> None:
        Scratch._open.discard(self)
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


@atexit.register
def _drop_open() -> None:
    for s in list(Scratch._open):
        s.drop_all()


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are under the bound; else unchanged, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def parts_for(rows: int) -> int:
    """Ranges or blocks for so many rows, so that a task has about TASK_ROWS of them."""
    return max(8, min(MOST_PARTS, -(-rows // TASK_ROWS)))


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], blocks: int, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row within its key, without one task per key.

    Each key's rows are spread over hash blocks of `order`; ranks within a block get the number of the key's rows in
    lower blocks added. A key with a third of all rows is thus ranked by `blocks` tasks. `order` has to be unique
    within a key for a repeatable result. The rank follows (block, order), not order alone.
    """
    block = F.pmod(F.xxhash64(*order), F.lit(blocks))
    marked = df.withColumn("_block", block)
    sizes = marked.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*key, "_block").orderBy(*order)
    rows = marked.withColumn("_r", F.row_number().over(inside) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [F.col("_block") == F.col("_b")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(starts, on).withColumn(name, F.col("_start") + F.col("_r")).select(*df.columns, name)


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], scratch: Scratch, parts: int | None = None, fold: Callable[..., Column] = F.sum) -> DataFrame:
    """Adds running sums over one total order, without one task for all rows; with fold=F.max running maxima.

    Rows are kept, which counts them; the number of ranges follows the count unless `parts` is given. They are then
    range-partitioned by the order and kept; each range gets the totals of the ranges before it, and sums within the
    range are a window per range.
    """
    cols = {f"_s{i}": c for i, c in enumerate(sums.values())}
    rows = df.select("*", *[c.alias(n) for n, c in cols.items()])
    if parts is None:
        source, n = scratch.keep_counted(rows, "rows")[:2]
        parts = parts_for(n)
    else:
        source = rows
    kept = scratch.keep(source.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    scratch.drop(source)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("_p").agg(*[fold(n).alias(n) for n in cols])
    starts = totals.select(F.col("_p").alias("_q"), *[fold(n).over(before).alias(f"{n}b") for n in cols])
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.join(F.broadcast(starts), F.col("_p") == F.col("_q"))
    whole = (lambda own, first: own + F.coalesce(first, F.lit(0))) if fold is F.sum else (lambda own, first: F.greatest(own, first))
    return out.select(*df.columns, *[whole(fold(n).over(inside), F.col(f"{n}b")).alias(name) for n, name in zip(cols, sums)])


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], scratch: Scratch, name: str = "n") -> DataFrame:
    """Adds the 1-based number of each row within its key in the given order, nulls first, without one task per key.

    All rows are numbered over (key, order) by ranges; a key's first number is then taken off. As ranked(), but in true
    order; `order` has to be unique within a key for a repeatable result.
    """
    cols = [F.col(c) for c in (*key, *order)]
    run = running_sums(df, cols, {name: F.lit(1).cast("long")}, scratch)
    if not key:
        return run
    starts = run.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(name).alias("_first"))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return run.join(starts, on).withColumn(name, F.col(name) - F.col("_first") + 1).select(*df.columns, name)
