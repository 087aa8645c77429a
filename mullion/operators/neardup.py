"""Exact and near duplicates by 64-bit hashes: within one population or across two.

Exact pairs have equal hashes, near pairs differ in 1 to `threshold` bits. Hashes are compared as distinct values first;
records are joined to the found pairs of values after. Rows with a null hash are left out; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mullion.functions.hashes import hamming_words, hash_words
from mullion.functions.records import hamming
from mullion.scale import BROADCAST_ROWS, Scratch, broadcast_if_small

#: Cost of comparing two hashes beside that of moving a row of a band, where all pairs are compared and where bands meet.
PAIR_COST, CANDIDATE_COST = 0.004, 0.1
#: Comparisons that one task of the blocked way is meant for.
TASK_PAIRS = 20_000_000


def check_threshold(threshold: int, bits: int = 64) -> None:
    """0 <= threshold < bits, whole numbers only."""
    if isinstance(threshold, bool) or not isinstance(threshold, int) or not 0 <= threshold < bits:
        raise ValueError(f"threshold must be a whole number from 0 to {bits - 1}")


def bands_cost(n_a: int, n_b: int, threshold: int, m: int) -> float:
    """Rows moved and candidates compared, if of threshold + m bands every m meet."""
    ways = comb(threshold + m, m)
    return ways * (n_a + n_b) + CANDIDATE_COST * ways * n_a * n_b / 2 ** (64 * m / (threshold + m))


def bands_for(n_a: int, n_b: int, threshold: int) -> tuple[int, int]:
    """(bands, equal): into how many bands to cut, and how many of them meet, for so many distinct hashes.

    Of threshold + m bands a near pair has m equal. A larger m means more rows per hash and longer keys, so fewer chance
    candidates: their number grows as the product of both sides, that of the rows as their sum.
    """
    m = min((m for m in range(1, 5) if comb(threshold + m, m) <= 250), key=lambda m: bands_cost(n_a, n_b, threshold, m), default=1)
    return threshold + m, m


def _met(h: str, cuts: list[int], masks: list[int]) -> F.Column:
    """One row (mask, key) per combination of bands; the key is a hash of the bands' contents."""
    rows = []
    for mask in masks:
        parts = [f"shiftrightunsigned({h}, {a}) & {(1 << (b - a)) - 1}L" for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if mask >> i & 1]
        rows.append(f"named_struct('mask', {mask}, 'key', xxhash64({', '.join(parts)}))")
    return F.explode(F.expr(f"array({', '.join(rows)})"))


def near_hashes(a: DataFrame, b: DataFrame | None, threshold: int, strategy: str = "auto") -> DataFrame:
    """(ha, hb, distance) of distinct hashes with 1 <= distance <= threshold; with one table, ha < hb.

    Distinct hashes are kept once, and counted as they are written. strategy blocked: the smaller side is broadcast and
    every pair is compared within generated code; refused above BROADCAST_ROWS. banded: hashes meet where enough of their
    bands are equal, and each pair is verified and given only by its first equal bands, so nothing has to be made
    distinct. auto takes what costs less by the counts; so does the number of bands. broad, for thresholds at which bands
    rule out little, is blocked as long as a side may be broadcast, else banded. All ways find the same pairs.
    """
    check_threshold(threshold)
    if threshold == 0:
        return a.select(F.col("h").alias("ha"), F.col("h").alias("hb"), F.lit(0).alias("distance")).where(F.lit(False))
    scratch = Scratch(a.sparkSession)
    left, n_a = scratch.keep_counted(a.select(F.col("h").alias("ha")).where("ha is not null").distinct(), "left")[:2]
    if b is None:
        right, n_b = left.select(F.col("ha").alias("hb")), n_a
    else:
        right, n_b = scratch.keep_counted(b.select(F.col("h").alias("hb")).where("hb is not null").distinct(), "right")[:2]
    d = hamming(F.col("ha"), F.col("hb"))
    wanted = d.between(1, threshold)
    if b is None:
        wanted = wanted & (F.col("ha") < F.col("hb"))
    small = min(n_a, n_b) <= BROADCAST_ROWS
    n, m = bands_for(max(1, n_a), max(1, n_b), threshold)
    if strategy == "auto":
        strategy = "blocked" if small and PAIR_COST * n_a * n_b <= bands_cost(n_a, n_b, threshold, m) else "banded"
    if strategy == "broad":
        strategy = "blocked" if small else "banded"
    if strategy == "blocked":
        if not small:
            raise ValueError("too many hashes to broadcast; take the banded strategy")
        parts = max(1, min(10_000, n_a * n_b // TASK_PAIRS))
        one, other = (left, right) if n_b <= n_a else (right, left)
        return one.repartition(parts).join(F.broadcast(other), wanted).select("ha", "hb", d.alias("distance"))
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [sum(1 << i for i in c) for c in combinations(range(n), m)]
    pairs = left.select("ha", _met("ha", cuts, masks).alias("k")).select("ha", "k.*").join(right.select("hb", _met("hb", cuts, masks).alias("k")).select("hb", "k.*"), ["mask", "key"]).where(wanted)
    # The first m equal bands of the pair, as a mask, one lowest bit after the other.
    equal = " + ".join(f"if((shiftrightunsigned(ha ^ hb, {x}) & {(1 << (y - x)) - 1}L) = 0, {1 << i}L, 0L)" for i, (x, y) in enumerate(zip(cuts, cuts[1:])))
    pairs = pairs.withColumn("rest", F.expr(equal)).withColumn("first", F.lit(0).cast("long"))
    for _ in range(m):
        pairs = pairs.withColumn("first", F.expr("first | (rest & -rest)")).withColumn("rest", F.expr("rest & (rest - 1)"))
    return pairs.where("first = mask").select("ha", "hb", d.alias("distance"))


def _members(a: DataFrame, b: DataFrame | None, threshold: int, strategy: str, carry: Sequence[str] = ()) -> DataFrame:
    """(id_a, id_b, distance, carried columns of b) of the records that hold near hashes; a pair as often as it is met."""
    hashes, n = Scratch(a.sparkSession).keep_counted(near_hashes(a, b, threshold, strategy), "near")[:2]
    ra = a.select(F.col("id").alias("id_a"), F.col("h").alias("ha")).distinct()
    rb = (b if b is not None else a).select(F.col("id").alias("id_b"), F.col("h").alias("hb"), *carry).distinct()
    return ra.join(broadcast_if_small(hashes, n), "ha").join(rb, "hb").select("id_a", "id_b", "distance", *carry)


def near_pairs(a: DataFrame, b: DataFrame | None, threshold: int, strategy: str = "auto") -> DataFrame:
    """(id_a, id_b, distance) of records (id, h); within one table each pair once, the smaller id first.

    Hashes that stand in many records on both sides give all their pairs; near_classes counts them instead.
    """
    out = _members(a, b, threshold, strategy)
    if b is None:
        out = out.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "distance")
    return out.groupBy("id_a", "id_b").agg(F.min("distance").alias("distance"))


def near_classes(a: DataFrame, b: DataFrame | None, threshold: int, strategy: str = "auto") -> DataFrame:
    """(ha, hb, distance, n_a, n_b): near hashes with the numbers of records that hold them; membership is the hash."""
    count = lambda t, s: t.where("h is not null").select("id", "h").distinct().groupBy(F.col("h").alias(f"h{s}")).agg(F.count(F.lit(1)).alias(f"n_{s}"))
    return near_hashes(a, b, threshold, strategy).join(count(a, "a"), "ha").join(count(b if b is not None else a, "b"), "hb").select("ha", "hb", "distance", "n_a", "n_b")


def pairs_outside(a: DataFrame, b: DataFrame, inside: str, threshold: int, strategy: str = "auto") -> DataFrame:
    """(id_a, id_b) of near records of b that no row of theirs marked by the boolean column `inside` would find.

    What a search of the whole has more than one of the marked part, from one search that carries the mark.
    """
    found = _members(a, b, threshold, strategy, [inside])
    return found.groupBy("id_a", "id_b").agg(F.max(F.coalesce(F.col(inside), F.lit(False))).alias("_in")).where("not _in").select("id_a", "id_b")


def near_wide(a: DataFrame, b: DataFrame, threshold: int, bits: int) -> DataFrame:
    """(id_a, id_b, distance) of records (id, h) whose hashes of `bits` bits, as arrays of longs, differ in at most
    `threshold` bits, equal ones too.

    Every word is cut into equal bands, more than `threshold` in all; near hashes share one. Rows with a null hash are
    left out; one of another length raises.
    """
    check_threshold(threshold, bits)
    words = hash_words(bits)
    per = -(-(threshold + 1) // words)
    if per > 32:
        raise ValueError("the threshold leaves bands of less than two bits")
    cuts = [64 * i // per for i in range(per + 1)]
    keys = ", ".join(f"named_struct('at', {w * per + i}, 'key', shiftrightunsigned(element_at(h, {w + 1}), {x}) & {(1 << (y - x)) - 1 if y - x < 64 else -1}L)" for w in range(words) for i, (x, y) in enumerate(zip(cuts, cuts[1:])))

    def side(t: DataFrame, s: str) -> DataFrame:
        sound = t.where("h is not null").select(F.col("id").alias(f"id_{s}"), F.expr(f"if(size(h) = {words}, h, raise_error('a hash of another width'))").alias("h")).distinct()
        return sound.select(f"id_{s}", F.col("h").alias(f"h{s}"), F.explode(F.expr(f"array({keys})")).alias("k")).select(f"id_{s}", f"h{s}", "k.*")

    d = hamming_words(F.col("ha"), F.col("hb"))
    met = side(a, "a").join(side(b, "b"), ["at", "key"]).select("id_a", "id_b", d.alias("distance")).where(F.col("distance") <= threshold)
    return met.groupBy("id_a", "id_b").agg(F.min("distance").alias("distance"))


def malformed(df: DataFrame, text: str, digits: int = 16) -> DataFrame:
    """The rows whose hash is there but is not exactly `digits` hexadecimal digits, with or without a leading 0x."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return df.where(F.col(text).isNotNull() & ~bare.rlike(f"^[0-9a-f]{{{digits}}}$"))


def require_hashes(df: DataFrame, text: str, digits: int = 16) -> DataFrame:
    """df, or an error with an example if a row's hash is malformed; the refusing form of reading hashes."""
    bad = malformed(df, text, digits).head()
    if bad is not None:
        raise ValueError(f"not {digits} hexadecimal digits: {bad[text]!r}")
    return df


def exact_links(a: DataFrame, b: DataFrame, key: str = "h") -> DataFrame:
    """Groups of equal hash across two tables: (key, n_a, n_b); copies are counted, not spread out into pairs."""
    ca = a.where(F.col(key).isNotNull()).select("id", key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_a"))
    cb = b.where(F.col(key).isNotNull()).select("id", key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_b"))
    return ca.join(cb, key)


def telemetry(a: DataFrame, b: DataFrame, threshold: int) -> DataFrame:
    """One row about a search: records, distinct hashes, value pairs that there are, and near and exact ones found."""
    check_threshold(threshold)
    na = a.agg(F.count("h").alias("records_a"), F.count_distinct("h").alias("distinct_a"))
    nb = b.agg(F.count("h").alias("records_b"), F.count_distinct("h").alias("distinct_b"))
    near = near_hashes(a, b, threshold).agg(F.count(F.lit(1)).alias("near_values"))
    same = a.select("h").where("h is not null").distinct().join(b.select("h").distinct(), "h").agg(F.count(F.lit(1)).alias("exact_values"))
    one = na.withColumn("_k", F.lit(1))
    for other in (nb, near, same):
        one = one.join(F.broadcast(other.withColumn("_k", F.lit(1))), "_k")
    return one.withColumn("possible", F.col("distinct_a") * F.col("distinct_b")).drop("_k")
