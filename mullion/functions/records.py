"""Readings of the fields of image records: splits, digests, perceptual hashes and untrusted scalar texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 8601 date and time, with or without an offset; groups: date, time, offset.
INSTANT = r"^\s*(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2})?\s*$"


def split_name(split: Column) -> Column:
    """train, val or test; null for anything else."""
    name = F.lower(F.trim(split))
    return F.when(name.isin("train", "val", "test"), name)


def digest(sha256: Column) -> Column:
    """A digest without letter case and outer blanks; null for a null or empty one."""
    return F.nullif(F.lower(F.trim(sha256)), F.lit(""))


def digest_bytes(digest: Column) -> Column:
    """A digest in few bytes, null for null: 32 for one of 64 hex digits, more for any other text, so that none meet.

    Equal bytes mean equal texts: a text of another form stands whole behind 33 blanks.
    """
    return F.when(digest.rlike(r"^[0-9a-f]{64}\z"), F.unhex(digest)).otherwise(F.encode(F.concat(F.lit(" " * 33), digest), "utf-8"))


def phash_bits(phash: Column) -> Column:
    """The 64 bits of a hash of exactly 16 hex digits as a signed long; null for anything else."""
    bare = F.regexp_replace(F.lower(F.trim(phash)), "^0x", "")
    return F.when(bare.rlike("^[0-9a-f]{16}$"), F.conv(bare, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def instant(text: Column, need_offset: bool = True) -> Column:
    """A text as a timestamp; null if it is no ISO instant, or has no offset although one is needed.

    The pattern comes first as a cast alone would take words like 'tomorrow'.
    """
    zone = F.regexp_extract(text, INSTANT, 3)
    zone = (
        F.when(zone == "", F.lit("" if need_offset else "Z"))
        .when(F.lower(zone) == "z", F.lit("Z"))
        .when(F.length(zone) == 3, F.concat(zone, F.lit(":00")))
        .when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
        .otherwise(zone)
    )
    iso = F.concat(F.regexp_extract(text, INSTANT, 1), F.lit("T"), F.regexp_extract(text, INSTANT, 2), zone)
    return F.when(text.rlike(INSTANT) & (zone != ""), iso.try_cast("timestamp"))


#: Exponent notations that 38 digits with 18 after the point hold exactly, and decimal notations of any length.
EXPONENT = r"^[+-]?\d{1,9}(?:\.\d{0,9})?[eE](?:-\d|\+?(?:\d|10))$"
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)$"


def number_form(text: Column) -> Column:
    """One spelling for all notations of a number ('1024', ' 1024.0', '1.024e3'); other texts stay, null is empty.

    Nothing is rounded: numbers of any length that differ anywhere have different forms. An exponent is resolved from
    -9 to 10, with up to nine digits on either side of the point; with others the text stays.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s _]", "")
    form = F.when(bare.rlike(EXPONENT), bare.try_cast("decimal(38,18)").cast("string")).when(bare.rlike(DECIMAL), bare)
    for pattern, by in ((r"^\+", ""), (r"^(-?)\.", "$10."), (r"^(-?)0+(?=\d)", "$1"), (r"(\.\d*?)0+$", "$1"), (r"\.$", ""), ("^-0$", "0")):
        form = F.regexp_replace(form, pattern, by)
    # Most numbers are in the form already.
    return F.when(bare.rlike(r"^[1-9]\d*$"), bare).otherwise(F.coalesce(form, bare))


def boolean_form(text: Column) -> Column:
    """true or false for their usual notations; other texts stay, null is empty."""
    bare = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(bare.isin("true", "t", "yes", "y", "1", "1.0"), "true").when(bare.isin("false", "f", "no", "n", "0", "0.0"), "false").otherwise(bare)


def instant_form(text: Column) -> Column:
    """Microseconds since 1970 for an instant in any offset; other texts stay, null is empty."""
    return F.coalesce(F.unix_micros(instant(text, need_offset=False)).cast("string"), F.trim(text), F.lit(""))
