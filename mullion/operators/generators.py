"""Hash tables with known answers, for benchmarks and tests of the near-duplicate search; made by Spark, not the driver."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.operators.neardup import near_hashes

#: The hash that dense tables are made around. Fixed value.
ANCHOR = 0x0123456789ABCDEF
#: Ways to flip two and three bits of it.
PAIRS, TRIPLES = comb(64, 2), comb(64, 3)


def hash_table(spark: SparkSession, n: int, kind: str, threshold: int = 6, seed: int = 0) -> DataFrame:
    """(id, h) of n records.

    random: mixed bits, pairwise far apart. band: all share the low 16 bits, so that they meet in a band without being
    near. dense: distinct hashes within threshold / 2 bits of one anchor, so that all n (n - 1) / 2 pairs are near; the
    first 2016 differ from it in two bits, up to 41664 more (from a threshold of 6 on) in three.
    """
    ids = spark.range(n)
    mixed = F.xxhash64(F.col("id"), F.lit(seed))
    if kind == "random":
        return ids.select("id", mixed.alias("h"))
    if kind == "band":
        return ids.select("id", F.shiftleft(F.shiftrightunsigned(mixed, 16), 16).bitwiseOR(F.lit(0xBEEF)).alias("h"))
    if kind == "dense":
        half = threshold // 2
        if half < 2 or n > PAIRS + (TRIPLES if half > 2 else 0):
            raise ValueError(f"dense tables need a threshold of at least 4 and at most {PAIRS} records, or {PAIRS + TRIPLES} from 6 on")
        # The id-th pair of different bits of the anchor flipped: any two differ in at most four bits. After the pairs,
        # triples: with another triple at most six. k is the highest bit of a triple, of which comb(k, 3) have a lower one.
        at = F.col("id") - PAIRS
        below = F.lit(0).cast("long")
        k = F.lit(2)
        for x in range(3, 64):
            k = F.when(at >= comb(x, 3), F.lit(x)).otherwise(k)
            below = F.when(at >= comb(x, 3), F.lit(comb(x, 3)).cast("long")).otherwise(below)
        triple = F.col("id") >= PAIRS
        ids = ids.select("id", F.when(triple, k).alias("k"), F.when(triple, at - below).otherwise(F.col("id")).alias("rank"))
        j = F.floor((1 + F.sqrt(8 * F.col("rank").cast("double") + 1)) / 2).cast("int")
        i = (F.col("rank") - (j.cast("long") * (j.cast("long") - 1) / 2).cast("long")).cast("int")
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
        third = F.coalesce(bit(F.col("k")), F.lit(0).cast("long"))
        return ids.select("id", F.lit(ANCHOR).cast("long").bitwiseXOR(bit(i)).bitwiseXOR(bit(j)).bitwiseXOR(third).alias("h"))
    raise ValueError(f"unknown kind {kind}")


def search_counts(spark: SparkSession, sizes: tuple[int, ...], kind: str, threshold: int, strategy: str) -> DataFrame:
    """(kind, n, strategy, possible, found): the work of a search and what it found, per size."""
    out = None
    for n in sizes:
        found = near_hashes(hash_table(spark, n, kind, threshold), None, threshold, strategy).agg(F.count(F.lit(1)).alias("found"))
        row = found.select(F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"), F.lit(strategy).alias("strategy"), F.lit(n * (n - 1) // 2).cast("long").alias("possible"), "found")
        out = row if out is None else out.unionByName(row)
    return out
