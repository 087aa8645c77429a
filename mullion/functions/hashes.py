"""Hash expressions: bit distances of any width, canonical identities, and order-free digests of sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hex_bits(digits: Column) -> Column:
    """16 hex digits as a signed long with the same bits."""
    return F.conv(digits, 16, -10).cast("long")


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits."""
    return F.bit_count(hex_bits(a).bitwiseXOR(hex_bits(b)))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of any width, as arrays of longs of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hash_words(bits: int) -> int:
    """Longs that a hash of so many bits needs."""
    if bits < 1:
        raise ValueError("bits must be positive")
    return -(-bits // 64)


def sign_bits(values: Column, n: int) -> Column:
    """The signs of the first n <= 64 numbers of an array as bits of a long, the first as the highest."""
    if not 0 < n <= 64:
        raise ValueError("n must be from 1 to 64")
    bits = F.transform(F.slice(values, 1, n), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def canonical_id(prefix: Column | str, texts: dict[str, Column], numbers: dict[str, Column] | None = None, digits: int = 16) -> Column:
    """prefix-<hex>: the digest of a row's fields as JSON with sorted keys and no blanks.

    Null texts are empty texts; numbers keep their type. Two rows have one id exactly if all fields are equal.
    """
    fields = {n: F.coalesce(c, F.lit("")) for n, c in texts.items()} | (numbers or {})
    packed = F.struct(*[c.alias(n) for n, c in sorted(fields.items())])
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit("-"), F.substring(F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256), 1, digits))


def set_digest(df: DataFrame, identity: Column, name: str = "digest", levels: Sequence[int] = (4, 2)) -> DataFrame:
    """One row (n, digest): an order-free digest of a multiset of identities.

    A tree: equal identities are counted first, so that one with a third of all rows is one member with its count;
    members fall into buckets by the first hex digits of their own digest; a bucket's digest is over its sorted members. Buckets go into wider ones by fewer digits, and the whole is over the widest in order. So no task
    holds all identities: with 4 digits a bucket of 10^10 identities has some 150,000. Equal multisets, and only those,
    have equal digests. An empty set has the digest of an empty text.
    """
    counted = df.groupBy(F.sha2(F.coalesce(identity, F.lit("")), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    own = counted.select(F.sha2(F.concat("h", F.lit(":"), F.col("n").cast("string")), 256).alias("d"), "n").withColumn("b", F.col("d"))
    for digits in levels:
        members = F.array_sort(F.collect_list(F.struct("b", "d")))
        own = own.groupBy(F.substring("b", 1, digits).alias("p")).agg(F.sum("n").alias("n"), members.alias("l"))
        own = own.select(F.col("p").alias("b"), "n", F.sha2(F.array_join(F.transform("l", lambda x: x["d"]), "\n"), 256).alias("d"))
    tops = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("b", "d"))).alias("l"))
    return tops.select("n", F.sha2(F.array_join(F.transform("l", lambda x: x["d"]), "\n"), 256).alias(name))


def joined(columns: Sequence[str], separator: str = "\t") -> Column:
    """Columns as one text, nulls as empty texts, for identities."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
