"""Reachability and longest paths of directed graphs, with loops condensed.

A graph is a DataFrame of edges (src, dst). Graphs of tables and columns are catalogues: they grow with
the estate that is described and not with its rows. One of at most LOCAL distinct edges is solved in
one task in linear time; larger ones in distributed rounds that only carry the frontier on. Both ways
give the same rows. Rounds are cut by reliable checkpoints.

Loops: the nodes of a loop count as one node. All of them start when the last node before the loop
has ended, and edges inside the loop are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed

#: Distinct edges of a graph that one task solves.
LOCAL = 1_000_000


def components(after: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components of a graph, each before those that it leads to."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    found: list[list[str]] = []
    for first in after:
        if first in number:
            continue
        number[first] = low[first] = len(number)
        held.append(first)
        inside.add(first)
        work = [(first, iter(after[first]))]
        while work:
            node, left = work[-1]
            for other in left:
                if other not in number:
                    number[other] = low[other] = len(number)
                    held.append(other)
                    inside.add(other)
                    work.append((other, iter(after.get(other, ()))))
                    break
                if other in inside:
                    low[node] = min(low[node], number[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(held.pop())
                        inside.discard(own[-1])
                    found.append(own)
    return found[::-1]


def _edges(frames: Iterator[pd.DataFrame]) -> tuple[dict[str, list[str]], dict[str, float]]:
    """The graph of rows (src, dst, weight); rows without dst are nodes with their weight."""
    after: dict[str, list[str]] = {}
    weight: dict[str, float] = {}
    for frame in frames:
        for src, dst, w in frame.itertuples(index=False):
            if dst is None:
                weight[src] = w
                after.setdefault(src, [])
            else:
                after.setdefault(src, []).append(dst)
    return after, weight


def _reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    after, seeds = _edges(frames)
    seen, queue = set(seeds), list(seeds)
    while queue:
        for other in after.get(queue.pop(), ()):
            if other not in seen:
                seen.add(other)
                queue.append(other)
    yield pd.DataFrame({"id": sorted(seen)}, dtype="object")


def _longest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    after, weight = _edges(frames)
    start: dict[int, tuple[float, str | None]] = {}
    order = components(after)
    place = {n: k for k, own in enumerate(order) for n in own}
    rows = []
    for k, own in enumerate(order):
        begin, before = start.get(k, (0.0, None))
        for n in own:
            end = begin + weight.get(n, 0.0)
            rows.append((n, begin, end, before))
            for other in after[n]:
                at = place[other]
                if at != k:
                    had = start.get(at)
                    if had is None or end > had[0] or end == had[0] and (had[1] is None or n < had[1]):
                        start[at] = (end, n)
    yield pd.DataFrame(rows, columns=["id", "start", "finish", "before"])


def _loop_labels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    after, _ = _edges(frames)
    for targets in list(after.values()):
        for t in targets:
            after.setdefault(t, [])
    rows = [(n, min(own)) for own in components(after) if len(own) > 1 for n in own]
    yield pd.DataFrame(rows, columns=["id", "loop"])


def _in_one_task(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    rows = edges.select("src", "dst", F.lit(0.0).alias("weight"))
    if nodes is not None:
        rows = rows.union(nodes.select("id", F.lit(None).cast("string"), F.col("weight").cast("double")))
    return rows.repartition(1)


def reachable(edges: DataFrame, seeds: DataFrame, local: int | None = None) -> DataFrame:
    """The ids that seeds (id) reach over edges (src, dst), the seeds among them.

    Each round carries on from the ids that were new in the one before. Loops end it, as nothing on
    them is new twice. Cases: unknown seeds reach themselves; null ends are ignored; no seeds, no rows.
    """
    pairs = checkpointed(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    seeds = seeds.where("id is not null").select("id").distinct()
    if pairs.count() <= (LOCAL if local is None else local):
        return _in_one_task(pairs, seeds.withColumn("weight", F.lit(0.0))).mapInPandas(_reach, "id string")
    seen = new = checkpointed(seeds)
    while True:
        new = checkpointed(new.join(pairs, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if not new.take(1):
            return seen
        seen = checkpointed(seen.union(new))


def loops(edges: DataFrame, local: int | None = None) -> DataFrame:
    """(id, loop) of the nodes on loops of edges (src, dst); loop is an id of theirs."""
    most = LOCAL if local is None else local
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    while True:  # what nothing leads to, or leads nowhere, is on no loop
        pairs = checkpointed(pairs)
        n = pairs.count()
        kept = checkpointed(pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if n <= most or kept.count() == n:
            break
        pairs = kept
    if n <= most:
        return _in_one_task(pairs).mapInPandas(_loop_labels, "id string, loop string")
    found = None
    while pairs.take(1):
        # The greatest id that leads to a node is its colour; what of a colour leads back to that id is a loop
        colour = checkpointed(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            offers = colour.join(pairs, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "colour")
            grown = checkpointed(colour.union(offers).groupBy("id").agg(F.max("colour").alias("colour")))
            same = grown.join(colour.withColumnRenamed("colour", "was"), "id").where("colour <> was").take(1)
            colour = grown
            if not same:
                break
        side = lambda c: colour.select(F.col("id").alias(c), F.col("colour").alias(f"{c}_colour"))
        inner = pairs.join(side("src"), "src").join(side("dst"), "dst").where("src_colour = dst_colour").select("src", "dst")
        back = reachable(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("id = colour").select("id"), most)
        done = checkpointed(colour.join(back, "id", "left_semi").select("id", F.col("colour").alias("loop")))
        found = done if found is None else found.union(done)
        gone = done.select(F.col("id").alias("src"))
        pairs = checkpointed(inner.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
    size = found.groupBy("loop").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(size, "loop", "left_semi").select("id", "loop")


def longest_paths(edges: DataFrame, nodes: DataFrame, local: int | None = None) -> DataFrame:
    """(id, start, finish, before) of nodes (id, weight): the longest weighted path that ends with each.

    start is the greatest finish of the nodes before, finish adds the node's own weight, before is the
    node that start comes from, the least of equal ones, null at the beginning. Edges from or to
    unknown nodes, and from a node to itself, are skipped. Loops: see above. No nodes give no rows.
    """
    most = LOCAL if local is None else local
    nodes = checkpointed(nodes.where("id is not null").groupBy("id").agg(F.max("weight").cast("double").alias("weight")))
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    pairs = checkpointed(pairs.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    if pairs.count() <= most:
        return _in_one_task(pairs, nodes).mapInPandas(_longest, "id string, start double, finish double, before string")
    labels = checkpointed(loops(pairs, most))
    named = checkpointed(nodes.join(labels, "id", "left").select("id", "weight", F.coalesce("loop", "id").alias("part")))
    left = named.select(F.col("id").alias("src"), F.col("part").alias("src_part"), "weight")
    right = named.select(F.col("id").alias("dst"), F.col("part").alias("dst_part"))
    steps = checkpointed(pairs.join(left, "src").join(right, "dst").where("src_part <> dst_part").select("src", "src_part", "dst_part", "weight"))
    waits = steps.groupBy(F.col("dst_part").alias("part")).agg(F.count("*").alias("n"))
    parts = named.select("part").distinct()
    none = F.struct(F.lit(0.0).alias("start"), F.lit(None).cast("string").alias("before"))
    waiting = checkpointed(waits.select("part", "n", none.alias("best")))
    ready = checkpointed(parts.join(waits, "part", "left_anti").select("part", none.alias("best")))
    done = ready
    while ready.take(1):
        offers = ready.join(steps, F.col("part") == F.col("src_part")).select("dst_part", (F.col("best.start") + F.col("weight")).alias("start"), F.col("src").alias("before"))
        first = offers.groupBy("dst_part", "start").agg(F.min("before").alias("before"), F.count("*").alias("k"))
        told = first.groupBy(F.col("dst_part").alias("part")).agg(F.max(F.struct("start", "before")).alias("offer"), F.sum("k").alias("k"))
        better = F.col("offer.start") > F.col("best.start")
        equal = (F.col("offer.start") == F.col("best.start")) & (F.col("best.before").isNull() | (F.col("offer.before") < F.col("best.before")))
        moved = checkpointed(waiting.join(told, "part", "left").select("part", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n"), F.when(better | equal, F.col("offer")).otherwise(F.col("best")).alias("best")))
        ready = moved.where("n = 0").select("part", "best")
        waiting = moved.where("n > 0")
        done = checkpointed(done.union(ready))
    return named.join(done, "part").select("id", F.col("best.start").alias("start"), (F.col("best.start") + F.col("weight")).alias("finish"), F.col("best.before").alias("before"))
