import random
from collections import Counter

import pytest

from weftline.operators import hierarchy as H


def brute(links):
    up = {}
    for p, c in links:
        if p is not None and c is not None and p != c:
            up[c] = min(p, up.get(c, p))
    nodes = set(up) | set(up.values())
    trail = {}
    for n in nodes:
        path = [n]
        while path[-1] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        trail[n] = path
    out, paths = set(), {}
    for n in nodes:
        ring = n in up and up[trail[n][-1]] == n if trail[n][-1] in up else False
        loose = trail[n][-1] in up
        below = sum(m != n and n in trail[m] for m in nodes)
        kind = "cycle" if ring else "below" if loose else "tree"
        out.add((n, trail[n][-1] if kind == "tree" else "", len(trail[n]) - 1 if kind == "tree" else -1, below, kind))
        if kind == "tree":
            paths[n] = trail[n][::-1]
    return out, paths


@pytest.mark.parametrize("seed, local", [(0, None), (1, None), (2, 15)])
def test_random_forests_with_loops(spark, seed, local):
    pick = random.Random(seed)
    links = [(f"n{pick.randrange(max(1, k - 30), k + 1)}", f"n{k}") for k in range(1, 150) if pick.random() < 0.9]
    links += [("n9", "n5"), ("n5", "n7"), ("n7", "n9"), (None, "n3"), ("n4", None), ("n8", "n8")] if seed else []
    if seed > 1:  # a long loop with trees below it, and a chain
        links += [(f"c{k}", f"c{(k + 1) % 37}") for k in range(37)] + [(f"c{k}", f"d{k}") for k in range(37)] + [(f"d{k}", f"d{k}x{j}") for k in range(20) for j in range(k % 3)]
        links += [(f"e{k}", f"e{k + 1}") for k in range(60)]
    pick.shuffle(links)
    rows = spark.createDataFrame([(*x, 1) for x in links + links[:20]] or [], "parent string, child string, node int").repartition(3)
    want, paths = brute(links)
    assert {tuple(r) for r in H.hierarchies(rows, local).collect()} == want
    assert {r["node_key"]: r["path"] for r in H.paths(rows, local).collect()} == paths
    pairs = [tuple(r) for r in H.descendants(rows, local).collect()]
    below = Counter(a for a, _ in pairs)
    assert len(pairs) == len(set(pairs)) and {n: below[n] for n, *_ in want} == {n: d for n, _, _, d, _ in want} and all(a != b for a, b in pairs)


def test_chain_star_and_empty(spark):
    chain = [(f"c{k:03}", f"c{k + 1:03}") for k in range(70)] + [("hub", f"s{k}") for k in range(200)]
    got = {r["node_key"]: r for r in H.hierarchies(spark.createDataFrame(chain, "parent string, child string")).collect()}
    assert got["c070"]["node_depth"] == 70 and got["c000"]["n_desc"] == 70 and got["hub"]["n_desc"] == 200
    assert H.hierarchies(spark.createDataFrame([], "parent string, child string")).count() == 0


def test_hot_parent_is_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT_LEAST", 10)
    links = [("hub", f"s{k}") for k in range(400)] + [("top", "hub")] + [(f"s{k}", f"t{k}") for k in range(50)]
    got = {tuple(r) for r in H.hierarchies(spark.createDataFrame(links, "parent string, child string"), 30).collect()}
    assert got == brute(links)[0]


def test_column_links_leave_out_unusable_rows(spark):
    rows = spark.createDataFrame([(" A ", "x", "b", "Y "), ("a", "X", "B", "y"), ("a", "*", "b", "y"), (None, "x", "b", "y"), ("a", " ", "b", "y"), ("a", "x", "A", "X")], "st string, sc string, tt string, tc string")
    assert {tuple(r) for r in H.column_links(rows, ("st", "sc"), ("tt", "tc")).collect()} == {("a.x", "b.y")}
