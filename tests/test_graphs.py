import random
import time

import pytest

from weftline.operators import graphs as G


def brute(edges, nodes):
    after = {n: {b for a, b in edges if a == n and b != n and b in nodes} for n in nodes}
    reach = {}
    for n in nodes:
        seen, queue = set(), [n]
        while queue:
            for b in after[queue.pop()] - seen:
                seen.add(b)
                queue.append(b)
        reach[n] = seen
    part = {n: frozenset({m for m in reach[n] if n in reach[m]} | {n}) for n in nodes}
    start: dict = {}

    def begin(p):
        if p not in start:
            start[p] = max((begin(part[a]) + nodes[a] for a in nodes for b in after[a] if part[b] == p and part[a] != p), default=0.0)
        return start[p]

    return reach, part, {n: (begin(part[n]), begin(part[n]) + nodes[n]) for n in nodes}


@pytest.mark.parametrize("seed, local", [(1, None), (2, 0), (3, 12)])
def test_random_graphs(spark, seed, local):
    pick = random.Random(seed)
    nodes = {f"n{k}": float(pick.randrange(1, 5)) for k in range(30)}
    edges = [(f"n{pick.randrange(30)}", f"n{pick.randrange(30)}") for _ in range(38)]
    reach, part, times = brute(edges, nodes)
    rows = spark.createDataFrame([*edges, *edges[:5], (None, "n1"), ("n1", "gone")], "src string, dst string")
    weights = spark.createDataFrame(list(nodes.items()), "id string, weight double")
    got = {r["id"]: r for r in G.longest_paths(rows, weights, local).collect()}
    assert {n: (r["start"], r["finish"]) for n, r in got.items()} == times
    for n, r in got.items():
        feeders = [a for a, b in edges if b in part[n] and a not in part[n] and times[a][1] == times[n][0]]
        assert r["before"] == min(feeders, default=None)
    labels: dict = {}
    for r in G.loops(rows.where("src is not null and dst <> 'gone'"), local).collect():
        labels.setdefault(r["loop"], set()).add(r["id"])
    assert sorted(map(sorted, labels.values())) == sorted(map(sorted, {p for p in part.values() if len(p) > 1}))
    seeds = spark.createDataFrame([("n3",), ("n7",), ("zz",)], "id string")
    assert {r["id"] for r in G.reachable(rows, seeds, local).collect()} - {"gone"} == {"n3", "n7", "zz"} | reach["n3"] | reach["n7"]


def test_large_loop_is_fast(spark):
    edges = [(f"a{k}", f"a{(k + 1) % 1000}") for k in range(1000)] + [("x", "a3"), ("a7", "y")]
    began = time.time()
    nodes = spark.createDataFrame([(n, 1.0) for n in sorted({n for e in edges for n in e})], "id string, weight double")
    got = {r["id"]: r["start"] for r in G.longest_paths(spark.createDataFrame(edges, "src string, dst string"), nodes).collect()}
    assert got["x"] == 0 and got["a0"] == got["a999"] == 1 and got["y"] == 2 and time.time() - began < 10


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    ids = spark.createDataFrame([("a", 2.0)], "id string, weight double")
    assert [tuple(r) for r in G.longest_paths(none, ids).collect()] == [("a", 0.0, 2.0, None)]
    assert G.longest_paths(none, ids.limit(0)).count() == 0 and G.reachable(none, ids.limit(0)).count() == 0 and G.loops(none).count() == 0
