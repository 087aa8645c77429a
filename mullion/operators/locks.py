"""Locks and gates: facts and inputs bound by digest, their check, and evaluations that run only behind a passed gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.sources.sinks import json_digest

#: What stands for the digest of an input that is not there.
ABSENT = "<absent>"


def input_digests(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, sha256) of single files by name; an absent one has ABSENT.

    Files of one folder are read in one scan; contents never leave the executors.
    """
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    held = {}
    for name, path in paths.items():
        at = jvm.org.apache.hadoop.fs.Path(path)
        held[name] = path if at.getFileSystem(conf).exists(at) else None
    names = spark.createDataFrame([(n, p) for n, p in held.items()] or [], "name string, at string")
    there = [p for p in held.values() if p]
    if not there:
        return names.select("name", F.lit(ABSENT).alias("sha256"))
    found = spark.read.format("binaryFile").load(list(dict.fromkeys(there))).select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("p"), F.sha2("content", 256).alias("sha256"))
    return names.join(found, F.regexp_replace("at", "^[a-z0-9]+:/*", "/") == F.col("p"), "left").select("name", F.coalesce("sha256", F.lit(ABSENT)).alias("sha256"))


def digest_changes(bound: DataFrame, now: DataFrame) -> DataFrame:
    """(name, problem) of (name, sha256) tables: absent, unbound or changed inputs; the same ones are left out."""
    j = bound.select("name", F.col("sha256").alias("_b")).join(now.select("name", F.col("sha256").alias("_n")), "name", "full")
    problem = (
        F.when(F.col("_b").isNull(), "unbound").when(F.coalesce("_n", F.lit(ABSENT)) == ABSENT, "absent").when(F.col("_b") != F.col("_n"), "changed")
    )
    return j.select("name", problem.alias("problem")).where("problem is not null")


def bound_gate(checks: DataFrame, bound: DataFrame, now: DataFrame) -> DataFrame:
    """One row (n_checks, n_problems, n_changes, status) from (check, n_problems) and the inputs' digests.

    stale if any input is not the bound one, whatever the checks say; else incomplete without checks or with one that
    has no number, fail with problems, pass without. A gate thus never passes by being old or empty.
    """
    c = checks.agg(F.count(F.lit(1)).alias("n_checks"), F.coalesce(F.sum("n_problems"), F.lit(0)).alias("n_problems"), F.count_if(F.col("n_problems").isNull()).alias("_open"), F.max("n_problems").alias("_most"))
    d = digest_changes(bound, now).agg(F.count(F.lit(1)).alias("n_changes"))
    status = F.when(F.col("n_changes") > 0, "stale").when((F.col("n_checks") == 0) | (F.col("_open") > 0), "incomplete").when(F.col("_most") > 0, "fail").otherwise("pass")
    return c.withColumn("_k", F.lit(1)).join(d.withColumn("_k", F.lit(1)), "_k").select("n_checks", "n_problems", "n_changes", status.alias("status"))


def guarded(gate: DataFrame, evaluate: Callable[[], DataFrame]) -> DataFrame:
    """What evaluate() gives, if the one-row gate has passed; else an error, and nothing is evaluated."""
    row = gate.head()
    if row is None or row.status != "pass":
        raise PermissionError(f"the gate has not passed: {row.asDict() if row else 'no gate'}")
    return evaluate()


def build_lock(facts: dict[str, DataFrame], digests: DataFrame | None = None) -> dict:
    """Facts of one-row tables and input digests as one object with its own digest, free of times and of row order."""
    held = {}
    for name, df in facts.items():
        rows = df.limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{name} is not one row")
        held[name] = {k: v if isinstance(v, (int, float, bool, type(None))) else str(v) for k, v in rows[0].asDict().items()}
    lock: dict = {"facts": held, "inputs": {r.name: r.sha256 for r in digests.collect()} if digests is not None else {}}
    return lock | {"lock_digest": json_digest(lock)}


def lock_problems(lock: dict, fresh: dict) -> list[str]:
    """Why a lock does not hold against a fresh one: its own digest, then facts and inputs by name; none if it holds."""
    out = []
    if lock.get("lock_digest") != json_digest(lock, without=["lock_digest"]):
        out.append("lock_digest")
    for part in ("facts", "inputs"):
        a, b = lock.get(part, {}), fresh.get(part, {})
        out += [f"{part}.{k}" for k in sorted({*a, *b}) if a.get(k) != b.get(k)]
    return out


def require_lock(lock: dict, fresh: dict, names: Sequence[str] = ()) -> None:
    """Raises if the lock does not hold, or lacks one of the named facts."""
    problems = lock_problems(lock, fresh) + [f"facts.{n} is missing" for n in names if n not in lock.get("facts", {})]
    if problems:
        raise ValueError("the lock does not hold: " + ", ".join(problems))
