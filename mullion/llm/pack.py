"""Filling containers of fixed capacity with texts, none split unless it alone exceeds the capacity.

Method: Martello and Toth's reduction by dominance on the histogram of sizes, then best fit, largest first, for the
rest. Sizes are whole numbers up to the capacity, so that the whole plan is made from a histogram of at most `capacity`
counts, however many texts there are; texts of one size are interchangeable and get their places by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mullion.scale import Scratch, parts_for, ranked


class Plan:
    """Runs of equally filled containers: each run has a number of containers and, per size, how many items each holds."""

    def __init__(self, capacity: int):
        self.capacity, self.runs = capacity, []

    def add(self, times: int, contents: dict[int, int]) -> None:
        if times:
            self.runs.append((times, contents))

    def containers(self) -> int:
        return sum(t for t, _ in self.runs)


def reduce_by_dominance(counts: np.ndarray, capacity: int, plan: Plan) -> np.ndarray:
    """Fixes containers whose content dominates every other set that holds their largest item; the other counts remain.

    A set dominates another if the other's items can be exchanged, in parts, for items of it that are no smaller. For
    an item j, with r the room beside it:
    - nothing fits beside j: {j}
    - the largest item i that fits fills r, or no two items fit beside j, or no two that fit weigh more than i: {j, i}
    - at most two items fit, the best two are i and b, and no two items above b fit: {j, i, b}
    Each step is taken for as many copies as there are, since using items up never breaks its condition.
    """
    n = counts.copy()
    up, down = _Alive(n, 1), _Alive(n, -1)

    def smallest(k: int, without: int) -> list[int]:
        out: list[int] = []
        w = up.find(1)
        while w <= capacity and len(out) < k:
            out += [w] * min(int(n[w]) - (w == without), k - len(out))
            w = up.find(w + 1)
        return out

    for j in range(capacity, 0, -1):
        while n[j]:
            room = capacity - j
            low = smallest(3, j)
            fit = int(np.searchsorted(np.cumsum(low), room, side="right")) if low else 0
            if fit == 0:
                plan.add(int(n[j]), {j: 1})
                n[j] = 0
                break
            i = down.find(room)
            if i == j and n[j] == 1:
                i = down.find(j - 1)
            best = None
            if fit == 1 or i == room:
                best = (i,)
            elif fit == 2:
                a, b = _best_two(n, j, room)
                if i >= a + b:
                    best = (i,)
                elif a == i and not _two_above(n, j, b, room):
                    best = (a, b)
            if best is None:
                break
            used: dict[int, int] = {}
            for w in (j, *best):
                used[w] = used.get(w, 0) + 1
            times = min(int(n[w]) // k for w, k in used.items())
            plan.add(times, used)
            for w, k in used.items():
                n[w] -= times * k
            if not times:
                break
    return n


class _Alive:
    """The next size that still has items, upwards or downwards; sizes only run out, so steps over them are joined."""

    def __init__(self, n: np.ndarray, step: int):
        self.n, self.step, self.to = n, step, {}

    def find(self, s: int) -> int:
        """The nearest size from s on that has items; len(n) or more upwards, 0 or less downwards, if there is none."""
        n, to, path = self.n, self.to, []
        while 0 < s < len(n) and not n[s]:
            path.append(s)
            s = to.get(s, s + self.step)
        for x in path:
            to[x] = s
        return s


def _best_two(n: np.ndarray, j: int, room: int) -> tuple[int, int]:
    """The heaviest two items besides one j that fit into the room, the larger first."""
    n[j] -= 1
    try:
        return _heaviest_two(n, room)
    finally:
        n[j] += 1


def _heaviest_two(n: np.ndarray, room: int) -> tuple[int, int]:
    sizes = np.flatnonzero(n[: room + 1])
    sizes = sizes[sizes > 0]
    best, lo, hi = (0, 0), 0, len(sizes) - 1
    while lo <= hi:
        a, b = int(sizes[hi]), int(sizes[lo])
        if lo == hi and n[a] < 2:
            break
        if a + b > room:
            hi -= 1
        else:
            if a + b > sum(best):
                best = (a, b)
            lo += 1
    return best


def _two_above(n: np.ndarray, j: int, b: int, room: int) -> bool:
    """Whether two items larger than b, besides one j, fit into the room."""
    out: list[int] = []
    for w in np.flatnonzero(n[: room + 1]):
        if w > b:
            out += [int(w)] * min(int(n[w]) - (w == j), 2 - len(out))
            if len(out) == 2:
                return sum(out) <= room
    return False


def best_fit(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Best fit, largest first, for whole runs of equal items and equally filled containers at once."""
    open_runs: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]
    there = np.zeros(capacity + 1, dtype=bool)

    def put(room: int, times: int, content: tuple) -> None:
        open_runs[room].append((times, content))
        there[room] = True

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            # Of truth values argmax is the first true one, and looks no further.
            room = s + int(there[s:].argmax())
            if there[room]:
                times, content = open_runs[room].pop()
                there[room] = bool(open_runs[room])
            else:
                room, content = capacity, ()
                times = max(1, n // (capacity // s))
            per = room // s
            full = min(times, n // per)
            if full:
                put(room - per * s, full, (content, s, per))
                n -= full * per
                if times > full:
                    put(room, times - full, content)
            else:
                put(room - n * s, 1, (content, s, n))
                if times > 1:
                    put(room, times - 1, content)
                n = 0
    for runs in open_runs:
        for times, content in runs:
            held: dict[int, int] = {}
            while content:
                content, s, k = content
                held[s] = held.get(s, 0) + k
            plan.add(times, held)


def make_plan(counts: np.ndarray, capacity: int) -> Plan:
    """A plan for counts[s] items of each size s from 1 to the capacity; size 0 needs no room and is left out."""
    plan = Plan(capacity)
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    best_fit(reduce_by_dominance(counts, capacity, plan), capacity, plan)
    return plan


def _rank_bits(groups: int, most: int) -> int:
    """Bits of a key that are left for a rank below `most`, beside the number of one of so many (plan, size) groups."""
    bits = 63 - groups.bit_length()
    if most.bit_length() > bits:
        raise ValueError(f"{most} items of one size are too many for so many specifications of such capacities")
    return bits


def _slots(plans: list[Plan], width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run and size, where the ranks of its items begin: (key, first container, items per container)."""
    keys, first, per = [], [], []
    for p, plan in enumerate(plans):
        at, begun = 0, {}
        for times, held in plan.runs:
            for s, k in held.items():
                start = begun.get(s, 0)
                keys.append(((p * width + s) << bits) | start)
                first.append(at)
                per.append(k)
                begun[s] = start + times * k
            at += times
    order = np.argsort(np.asarray(keys, dtype=np.int64), kind="stable")
    return np.asarray(keys, dtype=np.int64)[order], np.asarray(first, dtype=np.int64)[order], np.asarray(per, dtype=np.int64)[order]


def pack(sizes: DataFrame, capacities: dict[int, int], blocks: int | None = None) -> DataFrame:
    """(spec_id, container_id, doc_id, part_no, n_tokens): a container for every text under each capacity.

    sizes: doc_id (unique), n_tokens >= 0; null counts as 0. capacities: by spec_id, each at least 1. A text over the
    capacity fills containers of its own, and only its last part is packed with others. Texts without tokens need no
    room and are spread over all containers. container_id is unique within a spec. Only the histogram of sizes comes to
    the driver; the plan sent to the executors is bounded by the capacities alone. Ranks within a size are taken in
    `blocks`, whose number follows the counted texts.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be at least 1")
    scratch = Scratch(sizes.sparkSession)
    specs = F.array(*[F.struct(F.lit(k).cast("int").alias("spec_id"), F.lit(v).cast("long").alias("capacity")) for k, v in capacities.items()])
    base, n_docs = scratch.keep_counted(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")), "sizes")[:2]
    blocks = blocks or max(64, parts_for(n_docs))
    each = base.select("doc_id", "n", F.explode(specs).alias("s")).select("s.spec_id", "s.capacity", "doc_id", "n")
    full = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    parts = each.withColumn("full", full).withColumn("size", (F.col("n") - F.col("full") * F.col("capacity")).cast("int"))
    items = parts.where((F.col("size") > 0) | (F.col("n") == 0))
    hist: dict[int, np.ndarray] = {k: np.zeros(v + 1, dtype=np.int64) for k, v in capacities.items()}
    for r in items.groupBy("spec_id", "size").agg(F.count(F.lit(1)).alias("c")).collect():
        hist[r.spec_id][r.size] = r.c
    names = list(capacities)
    width = max(capacities.values()) + 1
    plans = [make_plan(hist[k], capacities[k]) for k in names]
    bits = _rank_bits(len(plans) * width, max(int(h.max()) for h in hist.values()))
    keys, first, per = _slots(plans, width, bits)
    held = np.asarray([max(1, p.containers()) for p in plans], dtype=np.int64)
    index = np.asarray(names)

    @F.pandas_udf("long")
    def place(spec: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        order = np.argsort(index, kind="stable")
        p = order[np.searchsorted(index[order], spec.to_numpy())]
        s, q = size.to_numpy().astype(np.int64), rank.to_numpy().astype(np.int64)
        out = q % held[p]
        if len(keys):
            at = np.clip(np.searchsorted(keys, ((p * width + s) << bits) | q, side="right") - 1, 0, None)
            out = np.where(s > 0, first[at] + (q - (keys[at] & ((1 << bits) - 1))) // per[at], out)
        return pd.Series(out)

    seated = ranked(items.select("spec_id", "size", "doc_id", "full"), ["spec_id", "size"], ["doc_id"], blocks, "q")
    seated = seated.select("spec_id", F.concat(F.lit("b"), place("spec_id", "size", "q")).alias("container_id"), "doc_id", F.col("full").alias("part_no"), F.col("size").alias("n_tokens"))
    whole = parts.where("full > 0").select("spec_id", "capacity", "doc_id", F.explode(F.expr("sequence(0, full - 1)")).alias("part_no"))
    whole = whole.select("spec_id", F.concat(F.lit("d"), "doc_id", F.lit("."), "part_no").alias("container_id"), "doc_id", "part_no", F.col("capacity").cast("int").alias("n_tokens"))
    return seated.unionAll(whole)
