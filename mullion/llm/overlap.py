"""Same or near-same records across splits.

Method: the segment join of the edit-distance joins. Evaluation strings are cut into k+1 segments; a training string
within distance k must hold at least one of them unchanged, at an allowed position. Training substrings at the allowed
positions are matched with the segments, and each candidate is verified by the banded dynamic programme.

edit_segment_join is the operator. Its strings are texts, or strings of 64 bits held as longs, which differ by
substitutions alone, so that the only allowed position of a segment is its own.
"""

from __future__ import annotations

import gc
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions.records import hamming
from mullion.scale import Scratch

#: Segments beyond the k+1 that the distance needs: with k+1+x segments, 1+x of them must match.
EXTRA = range(1, 6)
#: Cost of verifying a candidate beside that of moving a row of a segment, for the choice among them.
CANDIDATE_COST = 0.5
#: Combinations of segments that are joined in one round; a round's rows are gone from the disk before the next.
ROUND_KEYS = 14


def choose_segments(n_train: int, n_eval: int, bits: int) -> int:
    """How many segments to cut 64 bits into, so that rows moved and candidates verified together cost least.

    More segments give more combinations per hash, but longer keys and so fewer chance candidates, whose number grows
    as the product of both sides. Every choice finds the same pairs, and holds as much on disk at a time.
    """

    def cost(s: int) -> float:
        must = s - bits
        combos = comb(s, must)
        return combos * (n_train + n_eval) + CANDIDATE_COST * combos * n_train * n_eval / 2 ** (64 * must / s)

    return min((bits + 1 + x for x in EXTRA if bits + 1 + x <= 16), key=cost)


def _content_bits(segments: int, must: int) -> int:
    """Bits that the contents of `must` segments need; the mask stands right above them, so that keys are short."""
    return -(-64 // segments) * must


def _keys(h: str, segments: int, masks: list[int], above: int) -> F.Column:
    """One row per combination of segments: its mask of segments in the high bits, their contents below."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    keys = []
    for m in masks:
        parts, at = [f"({m}L << {above})"], 0
        for i in range(segments):
            if m >> i & 1:
                width = cuts[i + 1] - cuts[i]
                parts.append(f"((shiftrightunsigned({h}, {cuts[i]}) & {(1 << width) - 1}L) << {at})")
                at += width
        keys.append(f"({' | '.join(parts)})")
    return F.explode(F.expr(f"array({', '.join(keys)})"))


def _free_shuffles(spark: SparkSession) -> None:
    """Has the shuffle files of what is no longer referred to removed now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bit_strings(train: DataFrame, evaluation: DataFrame, k: int, segments: int | None) -> DataFrame:
    """edit_segment_join of strings of 64 bits, held as longs.

    With s segments at least s - k of them are equal in a wanted pair; hashes meet on every combination of so many, and
    a pair is kept only where its first equal segments meet, hence once. The number of segments follows from the counted
    hashes. Combinations are joined in rounds, of which only the verified pairs are kept.

    A candidate is verified by the banded programme over its 16 hexadecimal digits, of which no more than k can differ,
    over its 64 bits, and by counting the substitutions.
    """
    if not 0 <= k <= 12:
        raise ValueError("k must be from 0 to 12 for bits")
    spark = train.sparkSession
    scratch = Scratch(spark)
    t = scratch.keep(train.select("h").where("h is not null").distinct(), "train")
    e = scratch.keep(evaluation.select("h").where("h is not null").distinct(), "eval")
    n_train, n_eval = t.count(), e.count()
    if segments is None:
        segments = choose_segments(max(1, n_train), max(1, n_eval), k)
    must = segments - k
    above = _content_bits(segments, must)
    if not 1 <= must <= 16 - k or above + segments > 63:
        raise ValueError("no such number of segments")
    cuts = [64 * i // segments for i in range(segments + 1)]
    masks = [sum(1 << i for i in c) for c in combinations(range(segments), must)]
    equal = " | ".join(f"if((shiftrightunsigned(h_train ^ h_eval, {cuts[i]}) & {(1 << (cuts[i + 1] - cuts[i])) - 1}L) = 0, {1 << i}L, 0L)" for i in range(segments))
    digits = f"levenshtein(lpad(hex(h_train), 16, '0'), lpad(hex(h_eval), 16, '0'), {k}) >= 0"
    symbols = f"levenshtein(lpad(bin(h_train), 64, '0'), lpad(bin(h_eval), 64, '0'), {k}) >= 0"
    kept = []
    for at in range(0, len(masks), ROUND_KEYS):
        some = masks[at : at + ROUND_KEYS]
        a = t.select(F.col("h").alias("h_train"), _keys("h", segments, some, above).alias("key"))
        b = e.select(F.col("h").alias("h_eval"), _keys("h", segments, some, above).alias("key"))
        near = a.join(b, "key").where(digits).where(symbols).where(hamming(F.col("h_train"), F.col("h_eval")) <= k)
        mask = near.select("h_train", "h_eval", F.expr(f"({equal})").alias("equal"), F.expr(f"shiftrightunsigned(key, {above})").alias("m"))
        for step in (1, 2, 4, 8):
            # All bits up to the combination's highest, one doubling at a time.
            mask = mask.withColumn("upto", F.expr(f"{'m' if step == 1 else 'upto'} | shiftrightunsigned({'m' if step == 1 else 'upto'}, {step})"))
        once = mask.where("(equal & upto) = m")
        kept.append(scratch.keep(once.select("h_train", "h_eval", hamming(F.col("h_train"), F.col("h_eval")).alias("distance")), "pairs"))
        del a, b, near, mask, once
        if len(masks) > ROUND_KEYS:
            _free_shuffles(spark)
    scratch.drop(t, e)
    out = kept[0]
    for x in kept[1:]:
        out = out.unionAll(x)
    return out


def edit_segment_join(train: DataFrame, evaluation: DataFrame, k: int, bits: bool = False, segments: int | None = None) -> DataFrame:
    """Pairs (s_train, s_eval, distance) of distinct strings (column s) within edit distance k.

    With bits, the strings are of 64 bits, held as longs in a column h, and differ by substitutions alone: pairs
    (h_train, h_eval, distance) that differ in at most k bits. `segments` forces their number there; it changes no row.

    Every evaluation string is cut into k+1 segments. A training string of length m looks for segment i of strings of
    each length n from m-k to m+k, at positions that differ from the segment's own by at most k and by no more than
    the edits left on either side allow. Candidates are verified by the banded dynamic programme of levenshtein with
    a threshold. Strings with fewer than k+1 characters have empty segments; they are compared with all strings of up
    to 2k characters, whose number the alphabet bounds only loosely, but which no hash or path column holds.

    Nulls are left out, repeats count once; long texts are compared whole.
    """
    if bits:
        return _bit_strings(train, evaluation, k, segments)
    if k < 0:
        raise ValueError("k must not be negative")
    parts = k + 1
    t = train.select(F.col("s").alias("s_train")).where("s_train is not null").distinct().withColumn("m", F.length("s_train"))
    e = evaluation.select(F.col("s").alias("s_eval")).where("s_eval is not null").distinct().withColumn("n", F.length("s_eval"))
    cut = f"""transform(sequence(0, {k}), i -> named_struct('i', i, 'n', n, 'at', i * n div {parts}, 'x', substring(s_eval, i * n div {parts} + 1, (i + 1) * n div {parts} - i * n div {parts})))"""
    segments = e.where(f"n >= {parts}").select("s_eval", F.explode(F.expr(cut)).alias("g")).select("s_eval", "g.n", "g.i", "g.x")
    lengths = f"filter(sequence(m - {k}, m + {k}), n -> n >= {parts})"
    places = (
        f"flatten(transform({lengths}, n -> flatten(transform(sequence(0, {k}), i -> transform("
        f"filter(sequence(greatest(0, i * n div {parts} - {k}), i * n div {parts} + {k}), p -> abs(p - i * n div {parts}) + abs((m - p) - (n - i * n div {parts})) <= {k}"
        f" and p + ((i + 1) * n div {parts} - i * n div {parts}) <= m),"
        f" p -> named_struct('n', n, 'i', i, 'x', substring(s_train, p + 1, (i + 1) * n div {parts} - i * n div {parts})))))))"
    )
    probes = t.select("s_train", F.explode(F.array_distinct(F.expr(places))).alias("g")).select("s_train", "g.n", "g.i", "g.x")
    found = probes.join(segments, ["n", "i", "x"]).select("s_train", "s_eval").distinct()
    short_e, short_t = e.where(f"n < {parts}").select("s_eval", "n"), t.where(f"m <= {2 * k}").select("s_train", "m")
    lengths_of = short_e.select("s_eval", F.explode(F.expr(f"sequence(greatest(0, n - {k}), n + {k})")).alias("m"))
    found = found.unionAll(lengths_of.join(short_t, "m").select("s_train", "s_eval"))
    return found.select("s_train", "s_eval", F.levenshtein("s_train", "s_eval", k).alias("distance")).where("distance >= 0")


def near_classes(records: DataFrame, bits: int = 6) -> DataFrame:
    """(h_train, h_eval, distance, n_train, n_eval): classes of equal hash that are near across the splits.

    One row per pair of hashes with the numbers of records that hold each, so that copies are counted instead of spread
    into all their pairs; membership is the records' own hash. Readings as in cross_split_pairs.
    """
    rows = records.where(F.col("side").isin("train", "eval") & F.col("record_id").isNotNull() & F.col("h").isNotNull()).select("record_id", "side", "h").distinct()
    n = rows.groupBy("side", "h").agg(F.count(F.lit(1)).alias("n"))
    near = edit_segment_join(rows.where("side = 'train'"), rows.where("side = 'eval'"), bits, bits=True)
    a, b = (n.where(f"side = '{s}'").select(F.col("h").alias(f"h_{s}"), F.col("n").alias(f"n_{s}")) for s in ("train", "eval"))
    return near.join(a, "h_train").join(b, "h_eval").select("h_train", "h_eval", "distance", "n_train", "n_eval")


def cross_split_pairs(records: DataFrame, bits: int = 6) -> DataFrame:
    """Pairs (record_id_a, record_id_b, digest_equal, distance) of a training and an evaluation record.

    records: record_id, side ('train' or 'eval'), digest, h (64-bit hash as a long); null digests and hashes match
    nothing, other sides are left out. A pair comes out if the digests are equal or the hashes differ in at most `bits`
    bits; ids are in rising order, and a record never pairs with itself. Repeated rows count once; a record that has
    several rows matches by any of them. Hashes are compared as distinct values, the records joined to them after.
    """
    rows = records.where(F.col("side").isin("train", "eval") & F.col("record_id").isNotNull()).select("record_id", "side", "digest", "h").distinct()
    train, held = rows.where("side = 'train'"), rows.where("side = 'eval'")
    same = train.where("digest is not null").select(F.col("record_id").alias("t"), "digest").distinct().join(
        held.where("digest is not null").select(F.col("record_id").alias("e"), "digest").distinct(), "digest"
    )
    near = edit_segment_join(train, held, bits, bits=True)
    by_hash = near.join(train.select(F.col("record_id").alias("t"), F.col("h").alias("h_train")).distinct(), "h_train").join(
        held.select(F.col("record_id").alias("e"), F.col("h").alias("h_eval")).distinct(), "h_eval"
    )
    pairs = same.select("t", "e", F.lit(True).alias("d"), F.lit(None).cast("int").alias("distance")).unionAll(by_hash.select("t", "e", F.lit(False), F.col("distance").cast("int")))
    pairs = pairs.where("t <> e").select(F.least("t", "e").alias("record_id_a"), F.greatest("t", "e").alias("record_id_b"), "d", "distance")
    return pairs.groupBy("record_id_a", "record_id_b").agg(F.max("d").alias("digest_equal"), F.min("distance").alias("distance"))
