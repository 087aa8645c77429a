"""Text expressions: label forms, placeholder tokens, identities and pattern scans, as columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def label_form(label: Column) -> Column:
    """Separators (runs of _ and -) and white space to single blanks, trimmed, lower case; null stays null."""
    return F.lower(F.trim(F.regexp_replace(label, r"[_\-\s]+", " ")))


def first_alias(form: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """The name of the first alias, in list order, that stands in a label form as whole words; else an empty text."""
    found = F.lit("")
    for alias, name in reversed(list(aliases)):
        found = F.when(form.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(alias)}(?![\p{{L}}\p{{N}}_])"), name).otherwise(found)
    return found


def remainder(form: Column, aliases: Sequence[tuple[str, str]], subject: Column | None = None, generic: Sequence[str] = ("leaf",), whole: str = "healthy") -> Column:
    """What a label form says besides its subject: all words but generic ones and those of the subject's aliases.

    A form that holds `whole` is that word; a form of which nothing is left stays as it is. `subject` spares finding the
    first alias again where it is a column already.
    """
    subject = first_alias(form, aliases) if subject is None else subject
    words: dict[str, set[str]] = {}
    for alias, name in aliases:
        words.setdefault(name, set()).update(alias.split())
    own = F.create_map(*[x for name, w in words.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in sorted(w | set(generic))]))])
    drop = F.coalesce(F.try_element_at(own, subject), F.array(*[F.lit(w) for w in generic]))
    rest = F.array_join(F.filter(F.split(form, " "), lambda w: ~F.array_contains(drop, w)), " ")
    return F.when(form.contains(whole), whole).otherwise(F.coalesce(F.nullif(rest, F.lit("")), form))


def canonical_name(subject: Column, state: Column) -> Column:
    """subject__state, blanks to _, commas dropped, lower case."""
    return F.lower(F.replace(F.replace(F.concat_ws("__", subject, state), F.lit(" "), F.lit("_")), F.lit(","), F.lit("")))


def blank(value: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit("")) == ""


def is_placeholder(value: Column, tokens: Sequence[str]) -> Column:
    """Blank, or nothing but one of the tokens in any letter case."""
    return blank(value) | F.lower(F.trim(value)).isin([t.lower() for t in tokens])


def embedded_token(value: Column, tokens: Sequence[str]) -> Column:
    """The longest token standing in the text with boundaries that suit its own edges; null if there is none."""
    text = F.lower(F.regexp_replace(value, r"\s+", " "))
    hits = []
    for t in sorted(tokens, key=lambda x: (-len(x), x)):
        left = r"(?<!\w)" if t[0].isalnum() else r"(?<!\S)"
        right = r"(?!\w)" if t[-1].isalnum() else r"(?!\S)"
        hits.append(F.when(text.rlike(left + re.escape(t) + right), t))
    return F.coalesce(*hits)


@F.arrow_udf(T.StringType())
def fold_key(text: pa.Array) -> pa.Array:
    """NFC and full case folding, which lower() is not: ß becomes ss."""
    return pa.array([None if x is None else unicodedata.normalize("NFC", x).casefold() for x in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def identity_key(text: pa.Array) -> pa.Array:
    """NFKC, white space collapsed, case folded; null is empty. Two spellings of one person have one key."""
    return pa.array(["" if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold() for x in text.to_pylist()], pa.string())


def mentions(text: Column, word: str) -> Column:
    """Whether an identifier stands in the text as a word, in any letter case."""
    return F.coalesce(text.rlike(rf"(?i)(?<!\w){re.escape(word)}(?!\w)"), F.lit(False))


def denied(name: Column, names: Sequence[str]) -> Column:
    """Whether a source name equals or holds a forbidden one, separators and letter case aside."""
    form = F.lower(F.regexp_replace(F.trim(name), r"[\s_-]+", " "))
    out = F.lit(False)
    for n in names:
        out = out | form.contains(re.sub(r"[\s_-]+", " ", n.strip().lower()))
    return F.coalesce(out, F.lit(False))


def cited(texts: Sequence[Column], pattern: str, group: int = 0) -> Column:
    """All distinct matches of a pattern in several texts, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(pattern), F.lit(group))))


def scan(text: Column, patterns: dict[str, str]) -> Column:
    """All matches of named patterns as an array of (name, found)."""

    def hits(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(name).alias("name"), m.alias("found")))

    return F.flatten(F.array(*[hits(n, p) for n, p in patterns.items()]))


def numbers(text: Column) -> Column:
    """Every number written in a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def tag_after(path: Column, mark: str = "___") -> Column:
    """What follows the first mark in a path's stem, trimmed; empty if there is none."""
    stem = file_stem(path)
    at = F.instr(stem, mark)
    return F.when(at > 0, F.trim(F.substr(stem, at + len(mark)))).otherwise("")


def collision_safe(path: Column, sha256: Column) -> Column:
    """The path with __ and 12 digits of the digest before its extension; an error for a digest of fewer digits."""
    short = F.coalesce(F.length(sha256), F.lit(0)) < 12
    made = F.regexp_replace(path, r"(\.[^./]+)?$", "") 
    tail = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return F.when(short, F.raise_error(F.lit("a digest of at least 12 digits is needed"))).otherwise(F.concat(made, F.lit("__"), F.substring(sha256, 1, 12), tail))


def grouped_digits(n: Column) -> Column:
    """An integer with commas between thousands."""
    return F.format_number(n, 0)


def p_text(p: Column) -> Column:
    """A p value with four digits, or <0.0001."""
    return F.when(p < 1e-4, "<0.0001").otherwise(F.format_string("%.4f", p))


#: Characters that typesetting takes for commands, and what stands for them. Fixed values.
TYPESET = {"\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}


def typeset(text: Column) -> Column:
    """A text with every special character replaced once, in one pass; null stays null."""
    held = F.create_map(*[F.lit(x) for kv in TYPESET.items() for x in kv])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(held, c), c)), "")


def typeset_row(cells: Sequence[Column]) -> Column:
    """A row of a typeset table: cells as texts, empty for null."""
    return F.concat(F.array_join(F.array(*[F.coalesce(typeset(c.cast("string")), F.lit("")) for c in cells]), " & "), F.lit(" \\\\"))


def utc_now() -> Column:
    """The present instant as a text in whole seconds; never part of what a digest is over."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
