"""Queries over all of their rows, held against brute force where their SQL leaves rows out."""

import hashlib
import json

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from mullion.operators import generators, neardup
from tests import oracle


def column_rows(name, *columns):
    """A table's rows as tuples, read without Spark."""
    return list(zip(*(pq.read_table(f"{oracle.DATA}/{name}.parquet").column(c).to_pylist() for c in columns)))


def test_merged_decisions_over_all_pairs(spark):
    fresh = {i for (i,) in column_rows("leakage_plantvillage_vs_plantdoc_pairs", "canonical_pair_id") if i is not None}
    held = {}
    for i, d in column_rows("cross_dataset_near_duplicate_review", "canonical_pair_id", "human_decision"):
        if i is not None:
            held[i] = max((x for x in (held.get(i), d) if x is not None), default=None)
    want = {(i, held.get(i), "kept" if i in held else "new") for i in fresh} | {(i, d, "lost") for i, d in held.items() if i not in fresh and d}
    got = [(r.id, r.human_decision, r.outcome) for r in entry.queries()["merged_decisions"](spark, oracle.DATA).collect()]
    assert len(got) == len(want) and set(got) == want


def test_merged_decisions_loses_only_what_is_gone(spark, tmp_path):
    pairs = [(1, "a"), (2, "b"), (3, "c"), (3, "c"), (5, None)]
    reviews = [("a", "keep"), ("b", None), ("y", "drop"), ("z", None), (None, "keep")]
    spark.createDataFrame(pairs, "pair_row_id long, canonical_pair_id string").write.parquet(f"{tmp_path}/leakage_plantvillage_vs_plantdoc_pairs.parquet")
    spark.createDataFrame(reviews, "canonical_pair_id string, human_decision string").write.parquet(f"{tmp_path}/cross_dataset_near_duplicate_review.parquet")
    got = entry.queries()["merged_decisions"](spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", "keep", "kept"), ("b", None, "kept"), ("c", None, "new"), ("y", "drop", "lost")]


def pair_id(training, evaluation):
    fields = {"evaluation_relpath": evaluation or "", "hash_bits": 64, "pair_type": "near", "training_relpath": training or ""}
    return "near-" + hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def test_canonical_pair_ids_of_all_pairs(spark):
    want = {(n, pair_id(t, e)) for n, t, e in column_rows("leakage_plantvillage_vs_plantdoc_pairs", "pair_row_id", "training_relpath", "evaluation_relpath")}
    got = [tuple(r) for r in entry.queries()["canonical_pair_ids"](spark, oracle.DATA).collect()]
    assert len(got) == len(want) and set(got) == want


def test_canonical_pair_ids_escape_what_json_escapes(spark, tmp_path):
    pairs = [(1, "a/b.jpg", "c/d.jpg"), (2, "a\\b.jpg", "c/d.jpg"), (3, "a/b.jpg", "c\\\\d.jpg"), (4, 'a"b', "c\td"), (5, "\\", None), (6, None, "é\\花")]
    spark.createDataFrame(pairs, "pair_row_id long, training_relpath string, evaluation_relpath string").write.parquet(f"{tmp_path}/leakage_plantvillage_vs_plantdoc_pairs.parquet")
    got = entry.queries()["canonical_pair_ids"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(n, pair_id(t, e)) for n, t, e in pairs} and len(got) == len(pairs)


def test_extra_records_are_found_and_claimed(spark):
    got = {r.shard_id: (r.extra_records, r.claimed_extra) for r in entry.queries()["p3_extra_claims"](spark, oracle.DATA).collect()}
    extra = {r.relpath for r in entry.queries()["p3_found"](spark, oracle.DATA).where("outcome = 'extra_records'").collect()}
    shards = {s for (s,) in column_rows("plantvillage_manifest_reconstruction", "shard_id")}
    assert set(got) == shards | {None}
    assert extra and got[None][0] == len(extra)
    claims = {}
    for s, n, *when in column_rows("plantvillage_manifest_reconstruction", "shard_id", "extra_records", "run_at_utc", "run_id"):
        if None not in when:
            claims.setdefault(s, []).append((when, n))
    assert claims and all(got[s][1] == max(x, key=lambda y: y[0])[1] for s, x in claims.items())


@pytest.mark.parametrize("kind", ["dense", "random", "band"])
def test_benchmark_at_the_survey_sizes_against_all_pairs(spark, kind):
    got = {r.n: (r.found, r.possible, r.strategy) for r in entry.queries()[f"hash_survey_{kind}"](spark, oracle.DATA).collect()}
    want = {}
    for n in (1000, 10_000):
        h = np.array([r.h for r in generators.hash_table(spark, n, kind).collect()], dtype=np.int64).view(np.uint64)
        assert len(set(h.tolist())) == n
        near = sum(int((np.bitwise_count(h[i] ^ h[i + 1 :]) <= 6).sum()) for i in range(n))
        want[n] = (near, n * (n - 1) // 2, "banded")
    assert got == want
    assert kind != "dense" or all(near == possible for near, possible, _ in got.values())


def test_dense_tables_up_to_their_bound(spark):
    n = generators.PAIRS + generators.TRIPLES
    h = [r.h for r in generators.hash_table(spark, n, "dense").collect()]
    assert len(set(h)) == n and {((x ^ generators.ANCHOR) & (1 << 64) - 1).bit_count() for x in h} == {2, 3}
    for size, threshold in ((n + 1, 6), (2017, 4), (10, 3)):
        with pytest.raises(ValueError):
            generators.hash_table(spark, size, "dense", threshold)


def test_sign_pairs_beyond_a_broadcast(spark, monkeypatch, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{oracle.DATA}/embeddings.parquet").select("vec_id", "embedding").limit(150).collect()]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = {i: sum(1 << (63 - k) for k in range(64) if v[k] > 0) for i, v in rows}
    want = {(i, j, (x ^ y).bit_count()) for i, x in bits.items() for j, y in bits.items() if i < j and 1 <= (x ^ y).bit_count() <= 20}
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 100)
    got = [tuple(r) for r in entry.queries()["embedding_sign_pairs"](spark, str(tmp_path)).collect()]
    assert want and len(got) == len(want) and set(got) == want
