"""Paths: two spellings name one path if they differ only in separators, a leading ./, outer blanks or composition."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    plain = pc.fill_null(pc.string_is_ascii(texts), True)
    if pc.all(plain, min_count=0).as_py():
        return texts
    return pa.array([x if ok else unicodedata.normalize("NFC", x) for x, ok in zip(texts.to_pylist(), plain.to_pylist())], pa.string())


def nfc(text: Column) -> Column:
    """Unicode composition NFC, row by row only where a text isn't ASCII; null stays null."""
    return _composed(text)


def path_form(text: Column) -> Column:
    """Everything of the normal form that needs no Unicode tables: separators, leading ./ and outer blanks."""
    bare = F.regexp_replace(text, r"^[\s 　]+|[\s 　]+$", "")
    slashes = F.regexp_replace(bare, r"[/\\]+", "/")
    return F.nullif(F.regexp_replace(slashes, r"^(?:\./)+", ""), F.lit(""))


def normal_path(text: Column) -> Column:
    """The normal form of a path; null for a null, empty or blank one."""
    return path_form(nfc(text))
