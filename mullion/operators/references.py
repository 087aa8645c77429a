"""References to records that no parent table held at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mullion.scale import Scratch

#: The filter is broadcast up to so many words of 64 bits, 32 MB; a larger one is joined by shuffle, chunk by chunk.
MOST_WORDS = 1 << 22
#: Words in one row of the broadcast table; a row's array is far smaller than as many rows.
ROW_WORDS = 256
#: Bits set per key in its word, and keys that a word is meant for: about one key in a hundred passes by chance.
PROBES, KEYS_PER_WORD = 4, 5


def filter_words(n_keys: int) -> int:
    """Words for so many keys: a power of two, so that as few keys pass by chance at every size."""
    return max(ROW_WORDS, 1 << (max(1, n_keys) // KEYS_PER_WORD).bit_length())


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("word")), F.lit(words))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    mask = None
    for i in range(PROBES):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        mask = one if mask is None else mask.bitwiseOR(one)
    return mask


def bloom_filter(parents: DataFrame, key: str, words: int) -> DataFrame:
    """A blocked Bloom filter of the keys as (chunk, bits array<long>) of at most words / ROW_WORDS rows.

    Each key sets PROBES bits in one 64-bit word; words are an aggregate of bit_or, combined before the shuffle, then
    laid side by side by chunk.
    """
    w = parents.select(_word(F.col(key), words).alias("word"), _mask(F.col(key)).alias("m")).groupBy("word").agg(F.bit_or("m").alias("bits"))
    entry = F.struct((F.col("word") % ROW_WORDS).cast("int").alias("at"), "bits")
    rows = w.groupBy(F.shiftright("word", ROW_WORDS.bit_length() - 1).alias("chunk")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return rows.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bits"))


def orphans(
    references: DataFrame,
    parents: DataFrame,
    key: str = "key",
    at: str = "at",
    since: str = "since",
    until: str = "until",
) -> DataFrame:
    """The references (all their columns) whose key no parent row held at their time.

    parents: key, since, until; a row holds its key from since on and before until, without end if until is null. A
    null since is taken as always. References of unknown time (null `at`) are orphans only if no parent row ever had
    the key. References with a null key refer to nothing and are left out. Repeats on either side change nothing.

    Both sides' keys are compared as they are; bring them to one form before.

    A Bloom filter of the parent keys proves most orphans; only the references that pass it are joined exactly. It is
    broadcast up to a bound of its size; beyond, its chunks and the references meet by a shuffle on the chunk. References
    are read and tested once and kept. The exact part is an anti-join, whose hot keys adaptive execution can split on the
    left side; repeated parent rows are combined before.
    """
    scratch = Scratch(references.sparkSession)
    refs = references.where(F.col(key).isNotNull())
    held = parents.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(since).alias("_since"), F.col(until).alias("_until"))
    words = filter_words(held.agg(F.approx_count_distinct("_key")).head()[0])
    held = held.distinct()
    rows = bloom_filter(held, "_key", words).withColumnsRenamed({"chunk": "_chunk", "bits": "_held_bits"})
    tested = refs.withColumn("_word", _word(F.col(key), words))
    rows = F.broadcast(rows) if words <= MOST_WORDS else rows
    tested = tested.join(rows, F.shiftright("_word", ROW_WORDS.bit_length() - 1) == F.col("_chunk"), "left")
    own = F.try_element_at("_held_bits", (F.col("_word") % ROW_WORDS).cast("int") + 1)
    tested = tested.withColumn("_maybe", F.coalesce(own.bitwiseAND(_mask(F.col(key))) == _mask(F.col(key)), F.lit(False))).drop("_word", "_chunk", "_held_bits")
    tested = scratch.keep(tested, "tested")
    proven = tested.where(~F.col("_maybe")).drop("_maybe")
    live = F.col(at).isNull() | ((F.col("_since").isNull() | (F.col("_since") <= F.col(at))) & (F.col("_until").isNull() | (F.col(at) < F.col("_until"))))
    verified = tested.where("_maybe").drop("_maybe").join(held, (F.col(key) == F.col("_key")) & live, "left_anti")
    return proven.unionByName(verified)
