"""Consolidating pairwise matches into groups: one label per record over all records linked directly or through others.

Method: the component of the highest-degree vertex (the giant one, if there is one) is peeled off by breadth-first
joins of a frontier with the links; its links are anti-joined away; what remains is labelled by propagating minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.scale import BROADCAST_ROWS, Scratch, broadcast_if_small

#: Breadth-first rounds; a longer component is contracted to one vertex and left to the propagation of minima.
BFS_ROUNDS = 16
#: Rounds of propagation before giving up; each at least halves what is left, whatever the order of the ids.
MAX_ROUNDS = 200
#: Shifts (left if positive) whose exclusive ors mix the bits of an id one to one, and those that undo them. Fixed values.
MIX = (13, -7, 17) * 3
UNMIX = (17, 34, -7, -14, -28, -56, 13, 26, 52) * 3


def _shifted(c: str, steps: tuple[int, ...]) -> str:
    return f"aggregate(array({', '.join(map(str, steps))}), {c}, (a, s) -> a ^ if(s > 0, shiftleft(a, s), shiftrightunsigned(a, -s)))"


def _ids(vertices: DataFrame, links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Vertices as (id, kind, key) and links as (u, v) of 64-bit ids, proved free of collisions, and the links' number.

    An id is a hash of kind and key. If two keys ever share one, of vertices or of ends of links, another seed is taken.
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("kind_a").alias("kind"), F.col("a").alias("key")), F.struct(F.col("kind_b").alias("kind"), F.col("b").alias("key")))).alias("e"))
    everyone = vertices.select("kind", "key", F.lit(1).alias("listed")).unionAll(ends.select("e.kind", "e.key", F.lit(0)))
    for seed in range(20):
        known = everyone.groupBy("kind", "key").agg(F.max("listed").alias("listed"))
        named = scratch.keep(known.select(F.xxhash64(F.lit(seed), "kind", "key").alias("id"), "kind", "key", "listed"), "vertices")
        if named.groupBy("id").count().where("count > 1").isEmpty():
            edges = links.select(F.xxhash64(F.lit(seed), "kind_a", "a").alias("u"), F.xxhash64(F.lit(seed), "kind_b", "b").alias("v")).where("u <> v")
            edges, n = scratch.keep_counted(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")[:2]
            return named.where("listed = 1").drop("listed"), edges, n
        scratch.drop(named)
    raise RuntimeError("no seed without collisions")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def peel(links: DataFrame, n_links: int, scratch: Scratch, rounds: int = BFS_ROUNDS) -> tuple[DataFrame | None, int | None, bool, int]:
    """The vertices reached from the highest-degree vertex as (id), that vertex, whether the search came to its end, and
    their number.

    Each round joins the frontier with the links seen from both ends and drops the vertices of the last two layers; in
    an undirected graph no neighbour of a layer lies further back. A frontier is broadcast only if its counted rows
    are few; larger ones are joined by shuffle. Once half of the links that are left start in closed layers they are
    dropped, so that all rounds together read little more than the links a few times.
    """
    both, left = _both_ways(links), 2 * n_links
    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").select("u").head()
    if top is None:
        return None, None, True, 0
    spark = links.sparkSession
    layer = spark.createDataFrame([(top.u,)], "id long")
    last, layers, n, done, met, total, held = None, [layer], 1, False, 0, 1, None
    closed: list[tuple[DataFrame, int]] = []
    for _ in range(rounds):
        found = both.join(broadcast_if_small(layer, n), F.col("u") == F.col("id"), "left_semi").groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("c"))
        found = found.join(broadcast_if_small(layer, n), "id", "left_anti")
        if last is not None:
            found = found.join(last, "id", "left_anti")
        found, n_found, n_met = scratch.keep_counted(found, "layer", F.sum("c"))
        closed.append((layer, n))
        met += n_met or 0
        if not n_found:
            done = True
            break
        if 2 * met >= left:
            rest = both
            for x, size in closed:
                rest = rest.join(broadcast_if_small(x, size), F.col("u") == F.col("id"), "left_anti")
            both, left = scratch.keep_counted(rest, "open")[:2]
            scratch.drop(held) if held is not None else None
            held, closed, met = both, [], 0
        last, layer, n = layer, found.select("id"), n_found
        total += n_found
        layers.append(layer)
    seen = layers[0]
    for x in layers[1:]:
        seen = seen.unionAll(x)
    return seen, top.u, done, total


def propagate_minima(links: DataFrame, scratch: Scratch, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, label) of every vertex of the links; label is the id of a representative of its component.

    A round hooks every vertex to the least of its neighbours and itself, follows the hooks once more, and contracts the
    links to the vertices they lead to; the rounds' maps are composed at the end. Ids are compared by their mixed bits,
    so that no order of the ids makes long chains of hooks: a component of n vertices needs about log n rounds.
    """
    edges, maps, own = links, [], False
    for _ in range(rounds):
        least = F.expr(f"least(min({_shifted('v', MIX)}), {_shifted('u', MIX)})")
        hook = _both_ways(edges).groupBy("u").agg(least.alias("m")).select(F.col("u").alias("id"), F.expr(_shifted("m", UNMIX)).alias("to"))
        jump, n = scratch.keep_counted(hook.join(hook.select(F.col("id").alias("to"), F.col("to").alias("root")), "to").select("id", F.col("root").alias("to")), "jumps")[:2]
        if not n:
            scratch.drop(jump)
            break
        maps.append(jump)
        a, b = jump.select(F.col("id").alias("u"), F.col("to").alias("x")), jump.select(F.col("id").alias("v"), F.col("to").alias("y"))
        new = edges.join(broadcast_if_small(a, n), "u").join(broadcast_if_small(b, n), "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        new, n_new = scratch.keep_counted(new, "contracted")[:2]
        if own:
            scratch.drop(edges)
        edges, own = new, True
        if not n_new:
            break
    else:
        raise RuntimeError("propagation did not end")
    if not maps:
        return links.select(F.col("u").alias("id"), F.col("v").alias("label")).limit(0)
    final = maps[-1]
    for m in reversed(maps[:-1]):
        nxt = final.select(F.col("id").alias("to"), F.col("to").alias("root"))
        final = m.join(nxt, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    labels = scratch.keep(final.select("id", F.col("to").alias("label")), "labels")
    scratch.drop(edges if own else None, *maps)
    return labels


def linked_groups(vertices: DataFrame, links: DataFrame, bfs_rounds: int = BFS_ROUNDS) -> DataFrame:
    """(key, group_key) of every record: group_key is the smallest key of all records linked with it.

    vertices: (kind string, key string), kind 'record' for records, anything else for hubs that stand for a shared
    group and get no row. links: (kind_a, a, kind_b, b). A link through a hub replaces all pairs of the hub's members,
    so that a group with a third of all rows costs one link per member.

    Rows with a null key on any side link and name nothing. Repeats change nothing. A record without links is its own
    group. Empty tables give an empty result.
    """
    spark: SparkSession = vertices.sparkSession
    scratch = Scratch(spark)
    known = vertices.select("kind", "key").where(F.col("key").isNotNull())
    sound = links.select("kind_a", "a", "kind_b", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    named, edges, n_edges = _ids(known, sound, scratch)
    records = named.where("kind = 'record'").select("id", "key")
    giant, seed, done, n = peel(edges, n_edges, scratch, bfs_rounds)
    if giant is None:
        return records.select("key", F.col("key").alias("group_key"))
    small = broadcast_if_small(giant, n)
    if done:
        rest = edges.join(small, edges.u == giant.id, "left_anti")
    else:
        a, b = giant.select(F.col("id").alias("u"), F.lit(1).alias("in_u")), giant.select(F.col("id").alias("v"), F.lit(1).alias("in_v"))
        if n <= BROADCAST_ROWS:
            a, b = F.broadcast(a), F.broadcast(b)
        moved = edges.join(a, "u", "left").join(b, "v", "left").select(F.when(F.col("in_u") == 1, seed).otherwise(F.col("u")).alias("u"), F.when(F.col("in_v") == 1, seed).otherwise(F.col("v")).alias("v"))
        rest = moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rest = scratch.keep(rest, "rest")
    scratch.drop(edges)
    labels = propagate_minima(rest, scratch)
    scratch.drop(rest)
    seed_label = None if done else labels.where(F.col("id") == F.lit(seed)).head()
    # The giant component gets its least key as a constant, so that no join has it as one hot key.
    in_giant = F.col("_in").isNotNull()
    if seed_label is not None:
        in_giant = in_giant | (F.col("label") == F.lit(seed_label.label))
    flagged = records.join(broadcast_if_small(giant.select("id", F.lit(1).alias("_in")), n), "id", "left").join(labels, "id", "left")
    flagged, _, least = scratch.keep_counted(flagged.select("key", F.when(~F.coalesce(in_giant, F.lit(False)), F.coalesce("label", "id")).alias("label")), "flagged", F.min(F.when(F.col("label").isNull(), F.col("key"))))
    others = flagged.where("label is not null")
    by_label = others.groupBy("label").agg(F.min("key").alias("group_key"))
    return flagged.where("label is null").select("key", F.lit(least).alias("group_key")).unionAll(others.join(by_label, "label").select("key", "group_key"))
