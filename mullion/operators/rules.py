"""Rules on rows: all violations of a table in one scan, guards that raise, and authentication against identities.

A rule is (level, message, condition): the condition is true where the rule is broken; an unknown condition counts as
broken, so that a null never passes a check by accident.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mullion.functions.records import INSTANT, instant

Rule = tuple[str, str, Column]


def violations(df: DataFrame, rules: Sequence[Rule], where: Column) -> DataFrame:
    """(level, where, message): one row per broken rule and row, from one array per row that is exploded once."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(level).alias("level"), F.lit(message).alias("message"))) for level, message, bad in rules]))
    return df.select(where.alias("where"), F.explode(broken).alias("v")).select("v.level", "where", "v.message")


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("level", "message").agg(F.count(F.lit(1)).alias("n"))


def passing(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break no rule of level error."""
    ok = F.lit(True)
    for level, _, bad in rules:
        if level == "error":
            ok = ok & ~F.coalesce(bad, F.lit(True))
    return df.where(ok)


def require_none(found: DataFrame, what: str) -> None:
    """Raises if there is any violation of level error; the first three are named."""
    first = found.where("level = 'error'").limit(3).collect()
    if first:
        raise ValueError(f"{what}: " + "; ".join(f"{r['where']}: {r['message']}" for r in first))


def require_some(df: DataFrame, what: str) -> DataFrame:
    """The table, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(f"{what}: there are no rows")
    return df


def timestamp_problem(text: Column, now: Column | None = None) -> Column:
    """Why a text is no acceptable time: missing, malformed, no offset, invalid or in the future; null if it is one."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    at = instant(text)
    out = (
        F.when(bare == "", "missing")
        .when(~bare.rlike(INSTANT), "malformed")
        .when(F.regexp_extract(bare, INSTANT, 3) == "", "no offset")
        .when(at.isNull(), "invalid")
    )
    return out.when(at > now, "in the future") if now is not None else out


def missing_columns(df: DataFrame, needed: Sequence[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def authenticate(claims: DataFrame, known: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """(keys, problem, field): what stands between a table of claims and the identities it must match one to one.

    problem: unknown (a claim without identity), unclaimed (an identity without claim), repeated (several claims), or
    mismatch with the differing field. Null equals null. Identities must be unique by key; a repeated one is reported as
    repeated identity.
    """
    a = claims.select(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys], *[F.col(c).alias(f"a_{c}") for c in compared])
    b = known.select(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys], *[F.col(c).alias(f"b_{c}") for c in compared])
    # Small structs by key: any of several equal rows, and how many different ones there are.
    ga = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"), F.min(F.struct(*[f"a_{c}" for c in compared])).alias("ra"))
    gb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"), F.min(F.struct(*[f"b_{c}" for c in compared])).alias("rb"))
    j = ga.join(gb, list(keys), "full")

    def problem(name: str, field: str = "") -> Column:
        return F.struct(F.lit(name).alias("problem"), F.lit(field).alias("field"))

    both = F.col("na").isNotNull() & F.col("nb").isNotNull()
    found = [F.when(F.col("nb").isNull(), problem("unknown")), F.when(F.col("na").isNull(), problem("unclaimed")), F.when(F.col("na") > 1, problem("repeated")), F.when(F.col("nb") > 1, problem("repeated identity"))]
    found += [F.when(both & ~F.col(f"ra.a_{c}").eqNullSafe(F.col(f"rb.b_{c}")), problem("mismatch", c)) for c in compared]
    return j.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("p")).select(*keys, "p.problem", "p.field")


def readiness(present: DataFrame, expected: DataFrame, key: str, state: str, terminal: Sequence[str]) -> DataFrame:
    """(key, problem): expected keys that are missing, unexpected ones, repeated ones, and those without a final state."""
    p = present.groupBy(F.col(key).alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(state).isin(list(terminal)), F.lit(False))).alias("done"))
    j = p.join(expected.select(F.col(key).alias("_e")).distinct(), F.col("_p") == F.col("_e"), "full")
    found = F.when(F.col("_p").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.col("done") == 0, "not decided")
    return j.select(F.coalesce("_p", "_e").alias(key), found.alias("problem")).where("problem is not null")


def gate(checks: DataFrame) -> DataFrame:
    """One row from (check, n_problems): pass without problems, fail with any, incomplete if a check has no number."""
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.coalesce(F.sum("n_problems"), F.lit(0)).alias("n_problems"),
        F.when(F.count(F.lit(1)) == 0, "incomplete").when(F.count_if(F.col("n_problems").isNull()) > 0, "incomplete").when(F.max("n_problems") > 0, "fail").otherwise("pass").alias("status"),
    )


def shared_values(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Values (as a rationale or a set of citations) that stand in several groups, which should have each its own."""
    return df.select(F.col(group).alias("g"), value.alias("value")).where("value is not null and value <> ''").groupBy("value").agg(F.count_distinct("g").alias("n_groups")).where("n_groups > 1")


def before_reference(df: DataFrame, dim: DataFrame, key: str, at: str, reference: str) -> DataFrame:
    """Rows that are dated before what they refer to, or refer to nothing known: (key, at, reference, problem)."""
    d = dim.groupBy(F.col(key).alias("_k")).agg(F.min(reference).alias("_r"))
    j = df.select(key, at).join(d, F.col(key) == F.col("_k"), "left")
    problem = F.when(F.col("_k").isNull(), "no reference").when(F.col(at).isNull(), "no time").when(F.col(at) < F.col("_r"), "too early")
    return j.select(key, at, F.col("_r").alias("reference"), problem.alias("problem")).where("problem is not null")


def url_problem(url: Column, schemes: Sequence[str] = ("http", "https")) -> Column:
    """Why a text is no citable address: missing, no address, or another scheme; null if it is one."""
    bare = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://[^\s/]+", 1)
    return F.when(bare == "", "missing").when(scheme == "", "no address").when(~F.lower(scheme).isin(list(schemes)), "scheme")
