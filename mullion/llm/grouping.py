"""Splits that keep related records together.

Method: distributed union-find over the entities that records name, with local forests per partition that are merged
hierarchically; then greedy assignment, largest group first, to the split furthest below its target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mullion.scale import Scratch, parts_for, ranked

#: Each level of the merge has so many times fewer partitions than the one below.
FAN_IN = 8
#: Links that one task may hold as a forest; above it a level keeps several partitions.
LINKS_PER_TASK = 100_000
MAX_LEVELS = 100


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a partition's links (a, b): every node with its tree's least node."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while (p := parent[x]) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_numpy(), batch["b"].to_numpy()):
            if a not in parent:
                parent[a] = a
            if b != a:
                if b not in parent:
                    parent[b] = b
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]}, columns=["node", "root"])


def union_find(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for all nodes of the links (a, b); root is one node of the component, the same for all of it.

    Links are counted as they are kept. Level 0 builds a forest in each partition, of LINKS_PER_TASK links on average at
    most; links are spread by both ends, so that a node with a third of all links is in many forests. A node that stands
    in several forests links their roots; these links are the next level's input, in FAN_IN times fewer partitions (but
    never more than LINKS_PER_TASK links per task on average), until no node has two roots. Only roots that meet go up,
    so a level is far smaller than the one below. A link (a, a) declares a node.
    """
    level, n = scratch.keep_counted(links.select("a", "b"), "links")[:2]
    maps, parts = [], 1
    for _ in range(MAX_LEVELS):
        if maps and not n:
            break
        parts = max(-(-n // LINKS_PER_TASK), parts // FAN_IN, 1)
        level = level.repartition(parts, "a", "b")
        trees = scratch.keep(level.mapInPandas(_forest, "node string, root string"), "forest")
        lead = trees.groupBy("node").agg(F.min("root").alias("lead"), F.max("root").alias("other"))
        maps.append(lead.select("node", F.col("lead").alias("root")))
        split = lead.where("lead <> other").select("node", "lead")
        met = trees.join(split, "node").where("root <> lead").select(F.col("root").alias("a"), F.col("lead").alias("b")).distinct()
        level, n = scratch.keep_counted(met, "meeting")[:2]
    else:
        raise RuntimeError("the merge of the forests did not end")
    final = maps[-1]
    for m in reversed(maps[:-1]):
        up = final.select(F.col("node").alias("root"), F.col("root").alias("top"))
        final = m.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return final


def related_groups(rows: DataFrame, keys: Sequence[str], scratch: Scratch) -> DataFrame:
    """Adds `group` to the rows: one name for all rows that share any of their keys, directly or through others.

    A row with all keys null has a null group. Distinct key combinations are taken first, combined before the shuffle,
    so that an entity with a third of all rows is one node. Keys of different columns never meet.
    """
    named = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}|"), F.col(k))) for i, k in enumerate(keys)]
    combos = rows.select(*keys).distinct().select(F.array_compact(F.array(*named)).alias("nodes")).where(F.size("nodes") > 0)
    links = combos.select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b"))
    roots = union_find(links, scratch).select(F.col("node").alias("_node"), F.col("root").alias("group"))
    first = F.coalesce(*named)
    return rows.withColumn("_node_of", first).join(roots, F.col("_node_of") == F.col("_node"), "left").drop("_node_of", "_node")


def greedy_quota(sizes: dict[int, int], shares: dict[str, float]) -> dict[int, list[int]]:
    """For each group size, how many groups of it go to each split (in the order of shares).

    The greedy rule: the largest group first, to the split furthest below its target of rows; ties by the order of
    shares. Groups of one size are interchangeable, so that whole runs of the rule are taken at once: as long as each
    split's deficit stays above the others' by multiples of the size, the run's outcome is computed, not played.
    """
    total = sum(s * n for s, n in sizes.items())
    whole = sum(shares.values()) or 1.0
    deficit = [total * x / whole for x in shares.values()]
    quota: dict[int, list[int]] = {}
    for size in sorted(sizes, reverse=True):
        n, given = sizes[size], [0] * len(deficit)
        if size > 0 and n > 64:
            # After the run all deficits lie within one size of a level; take what surely stays above the level.
            order = sorted(deficit, reverse=True)
            level = max((sum(order[: k + 1]) - n * size) / (k + 1) for k in range(len(order)))
            for i, d in enumerate(deficit):
                sure = max(0, int((d - level) // size) - 1)
                given[i] += sure
                deficit[i] -= sure * size
            n -= sum(given)
        for _ in range(n):
            i = max(range(len(deficit)), key=lambda j: (deficit[j], -j))
            given[i] += 1
            deficit[i] -= size
        quota[size] = given
    return quota


def assign_splits(groups: DataFrame, shares: dict[str, float], blocks: int | None = None) -> DataFrame:
    """Adds `assigned` to groups (group_id unique, n rows): a split for every group with the wanted shares of rows.

    Only the histogram of group sizes comes to the driver. N rows have at most sqrt(2 N) different group sizes (their
    sum is at most N), half a million for 10^11 rows. The groups of a size are ranked in blocks, whose number follows the
    counted groups.
    """
    hist = {r.n: r.c for r in groups.groupBy("n").agg(F.count(F.lit(1)).alias("c")).toLocalIterator()}
    names, quota = list(shares), greedy_quota(hist, shares)
    rows = []
    for size, given in quota.items():
        at = 0
        for name, k in zip(names, given):
            if k:
                rows.append((size, at, at + k, name))
                at += k
    spark = groups.sparkSession
    ranges = spark.createDataFrame(rows, "_n long, _from long, _to long, assigned string")
    within = ranked(groups, ["n"], ["group_id"], blocks or max(64, parts_for(sum(hist.values()))), "_rank")
    if len(rows) <= 200_000:
        ranges = F.broadcast(ranges)
    return within.join(ranges, (F.col("n") == F.col("_n")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select(*groups.columns, "assigned")
