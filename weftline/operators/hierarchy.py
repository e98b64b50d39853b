"""Parent-child links to full hierarchies: roots, depths, paths, descendants and loops.

Every node has one parent at most, so the links form trees and, where they run in a circle, loops
with trees below them. The method is a weighted disjoint-set forest that is merged level by level:

  1. Links are put on the partition of their child. Each partition joins its own links in a weighted
     disjoint-set forest: a node without children below it is united with its parent, as far up as
     the partition holds the links, and keeps the number of links to it, its offset.
  2. A node that was united leaves the links; its parent in another partition gets the sums of what
     was united with it, added up in the partition first, so that a parent with a third of all nodes
     receives one row from each task. A node with a single child may be bridged: its child then
     hangs on the node above, at the added offset. A node is bridged if its coin of this level shows
     heads and that of its parent tails, so no two neighbours are bridged at once.
  3. Each level leaves a fraction of the links of the one before, so all levels together shuffle a
     small multiple of the links. The number of partitions falls with the links; what LOCAL rows can
     hold is finished in one forest, in which the links that close a circle give the loops.
  4. Offsets are then resolved from the last level back to the first: the root and depth of a node
     are those of the node it was united with, moved by the offset, and paths are materialised by
     the same traversal. Each level is one join on the node united with. Nodes with which much of a
     task was united are joined by broadcast, HOT of them at most, so no task receives them.

Levels are cut by reliable checkpoints. No tree, loop or list of nodes is gathered in one task beyond
LOCAL rows, or in the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import name_key
from weftline.session import checkpointed

#: Rows that one local forest holds at most, apart from the spread of hashing.
LOCAL = 200_000
#: Nodes joined by broadcast at most in a level, and the part of a task's rows that makes one of them.
HOT, HOT_SHARE, HOT_LEAST = 1_000, 0.01, 500

#: Rows between levels; mid is only filled, and only then a list, where names are wanted.
_STATE = "mark string, node string, up string, far long, under long, hidden long, mid {}, kids long, kid string, kind string"
_COLUMNS = ["mark", "node", "up", "far", "under", "hidden", "mid", "kids", "kid", "kind"]


def column_links(links: DataFrame, parent: tuple[str, str], child: tuple[str, str]) -> DataFrame:
    """Links between columns as (parent, child) node keys, table + '.' + column.

    Both parts are in lower case and without outer blanks. Rows with a null, blank or '*' table or
    column, and rows from a column to itself, are left out. Repeated links stay.
    """
    parts = {n: name_key(F.col(n)) for n in (*parent, *child)}
    usable = F.lit(True)
    for part in parts.values():
        usable = usable & part.isNotNull() & ~part.isin("", "*")
    node = lambda pair: F.concat_ws(".", parts[pair[0]], parts[pair[1]])
    return links.where(usable).select(node(parent).alias("parent"), node(child).alias("child")).where("parent <> child")


class _Node:
    """A node of a local forest that isn't united yet.

    far links lead to up, over the nodes mid; hidden nodes hang on the way there and under below the
    node itself, all of them already united. kids counts its children that are not.
    """

    __slots__ = ("up", "far", "under", "hidden", "mid", "kids", "kid")

    def __init__(self, up: str | None, far: int, under: int, hidden: int, mid: list[str]) -> None:
        self.up, self.far, self.under, self.hidden, self.mid = up, far, under, hidden, mid
        self.kids, self.kid = 0, ""


def _coin(node: str, level: int) -> bool:
    return bool(blake2b(f"{level} {node}".encode(), digest_size=1).digest()[0] & 1)


def _forest(level: int, bridge: bool, last: bool, named: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The work of one partition in one level.

    Rows come in and go out by mark: 'self' is a node, 'kid' tells node of its children and brings what
    was united with it, 'over' gives node a new parent. Out only: 'under' is a node united with up at
    the offset far, 'above' a bridged node which its child up resolves, 'top' a root or a node on a
    loop (up is then the root or the loop's least node), 'hot' a node that much was united with.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, _Node] = {}
        sums: Counter[str] = Counter()
        kids: dict[str, tuple[int, str]] = {}
        over: dict[str, tuple] = {}
        out: list[tuple] = []
        for frame in frames:
            for mark, node, up, far, under, hidden, mid, n, kid, _ in frame.itertuples(index=False):
                if mark == "self":
                    x = own[node] = _Node(up, far, under, hidden, list(mid) if mid is not None else [])
                    x.kids = n
                elif mark == "kid":
                    if under:
                        sums[node] += under
                    if n:
                        had = kids.get(node)
                        kids[node] = (n, kid) if had is None else (had[0] + n, kid)
                else:
                    over[node] = (up, far, under, hidden, list(mid) if mid is not None else [], kid)

        for node, x in own.items():
            x.under += sums.get(node, 0)
            n, x.kid = kids.get(node, (0, ""))
            x.kids += n
            if node in over:
                up, far, added, hidden, mid, bridged = over[node]
                out.append(("above", bridged, node, x.far, added + 1 + x.hidden, 0, None, 0, "", ""))
                x.up, x.far, x.hidden, x.mid = up, x.far + far, x.hidden + 1 + added + hidden, mid + ([bridged] if named else []) + x.mid

        def finish(ring: list[str]) -> None:
            """Roots, or the nodes of a loop in order from each to its parent."""
            whole = sum(1 + own[n].under + own[n].hidden for n in ring) - 1
            least = min((m for n in ring for m in (n, *own[n].mid)), default="") if named else ""
            for n in ring:
                out.append(("top", n, least, 0, whole, 0, None, 0, "", "cycle"))
                del own[n]

        # Unite nodes without children with their parents, as far as this partition reaches
        united: dict[str, tuple[str, int, list[str], int]] = {}
        order: list[str] = []
        given: Counter[str] = Counter()
        if not bridge:
            queue = [n for n, x in own.items() if not x.kids and x.up is not None]
            while queue:
                node = queue.pop()
                x = own.pop(node)
                united[node] = (x.up, x.far, x.mid, x.under)
                order.append(node)
                parent = own.get(x.up)
                if parent is None:
                    given[x.up] += 1 + x.under + x.hidden
                else:
                    parent.under += 1 + x.under + x.hidden
                    parent.kids -= 1
                    if not parent.kids and parent.up is not None:
                        queue.append(x.up)
        for node in reversed(order):  # parents come before their children
            up, far, mid, under = united[node]
            if up in united:
                above = united[up]
                united[node] = (above[0], above[1] + far, above[2] + ([up] if named else []) + mid, under)
        met: Counter[str] = Counter()
        for node, (up, far, mid, under) in united.items():
            met[up] += 1
            out.append(("under", node, up, far, under, 0, mid if named else None, 0, "", ""))
        floor = max(HOT_LEAST, HOT_SHARE * len(united))
        out += [("hot", up, None, 0, n, 0, None, 0, "", "") for up, n in met.items() if n >= floor]

        # Roots that have all in place, and loops that are down to one node
        for node in [n for n, x in own.items() if not x.kids and x.up is None]:
            out.append(("top", node, node, 0, own[node].under, 0, None, 0, "", "tree"))
            del own[node]
        for node in [n for n, x in own.items() if x.up == n and x.kids == 1]:
            finish([node])
        if last:  # all links are here, so what is left are loops
            while own:
                ring = [next(iter(own))]
                while own[ring[-1]].up != ring[0]:
                    ring.append(own[ring[-1]].up)
                finish(ring)

        told: dict[str, tuple[int, str]] = {}

        def tell(parent: str, kid: str) -> None:
            told[parent] = (told.get(parent, (0, ""))[0] + 1, kid)

        for node, x in own.items():
            if bridge and x.kids == 1 and x.up is not None and x.kid != node and x.up != node and _coin(node, level) and not _coin(x.up, level):
                out.append(("over", x.kid, x.up, x.far, x.under, x.hidden, x.mid if named else None, 0, node, ""))
                tell(x.up, x.kid)
            else:
                out.append(("self", node, x.up, x.far, x.under, x.hidden, x.mid if named else None, 0, "", ""))
                if x.up is not None:
                    tell(x.up, node)
        out += [("kid", up, None, 0, given.pop(up, 0), 0, None, n, kid, "") for up, (n, kid) in told.items()]
        out += [("kid", up, None, 0, n, 0, None, 0, "", "") for up, n in given.items()]
        for k in range(0, len(out), 50_000):
            yield pd.DataFrame(out[k : k + 50_000], columns=_COLUMNS)

    return run


def _first_level(links: DataFrame) -> DataFrame:
    """The nodes of links as states, each with its parent; of unlike parents the smallest counts.

    Ends are combined before the shuffle, so a parent with very many children is one row a task.
    """
    nothing = F.lit(None).cast("string")
    ends = links.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(0).alias("n")).union(
        links.select(F.col("parent").alias("node"), nothing.alias("up"), F.lit(1).alias("n"))
    )
    return ends.groupBy("node").agg(F.min("up").alias("up"), F.max("n").alias("n"))


def _expanded(spans: DataFrame, known: DataFrame, named: bool, mark: str) -> DataFrame:
    """(node, top, depth, n_desc, kind, path) of the nodes that spans of a mark resolve by known ones."""
    rows = spans.where(F.col("mark") == mark).select("mark", "node", F.col("up").alias("ref"), "far", F.col("under").alias("more"), "mid")
    other = known.select(F.col("node").alias("ref"), "top", "depth", "n_desc", "kind", "path")
    if mark == "under" and spans.where("mark = 'hot'").take(1):
        hot = spans.where("mark = 'hot'").groupBy("node").agg(F.sum("under").alias("n")).orderBy(F.desc("n"), "node").limit(HOT).select(F.col("node").alias("ref"))
        few = F.broadcast(hot)  # HOT rows at most, by its limit
        joined = rows.join(few, "ref", "left_anti").join(other, "ref").unionByName(rows.join(F.broadcast(other.join(few, "ref", "left_semi")), "ref"))
    else:
        joined = rows.join(other, "ref")
    below = F.col("mark") == "under"
    ring = F.col("kind") == "cycle"
    kind = F.when(below & ring, F.lit("below")).otherwise(F.col("kind"))
    depth = F.when(F.col("kind") != "tree", F.lit(-1).cast("long")).when(below, F.col("depth") + F.col("far")).otherwise(F.col("depth") - F.col("far"))
    n_desc = F.when(below, F.col("more")).when(ring, F.col("n_desc")).otherwise(F.col("n_desc") + F.col("more"))
    if named:
        path = (
            F.when(below, F.concat(F.col("path"), F.coalesce("mid", F.array().cast("array<string>")), F.array("node")))
            .when(ring, F.array("node")).otherwise(F.slice("path", 1, (F.size("path") - F.col("far")).cast("int")))
        )
    else:
        path = F.lit(None).cast("array<string>")
    return joined.select("node", "top", depth.alias("depth"), n_desc.alias("n_desc"), kind.alias("kind"), path.alias("path"))


def resolved(links: DataFrame, named: bool = False, local: int | None = None) -> DataFrame:
    """(node, top, depth, n_desc, kind, path) of each node of links (parent, child).

    top is the root; of nodes that lead into a loop it is the loop's least node, and depth is -1.
    path, only with named, has the nodes from the root, or from the place where a loop is left, down
    to the node. n_desc counts the other nodes that can be reached.
    """
    most = LOCAL if local is None else local
    usable = links.where("parent is not null and child is not null and parent <> child").select("parent", "child")
    first = _first_level(usable)
    empty = F.lit(None).cast("array<string>")
    listed = "array<string>" if named else "string"
    zero = F.lit(0).cast("long")
    # A node that some link names as parent is taken to have children, more than can be united here
    rows = first.select(
        F.lit("self").alias("mark"), "node", "up", F.lit(1).cast("long").alias("far"), zero.alias("under"), zero.alias("hidden"), F.lit(None).cast(listed).alias("mid"),
        (F.col("n") * F.lit(1 << 40)).alias("kids"), F.lit("").alias("kid"), F.lit("").alias("kind"),
    )
    levels: list[DataFrame] = []
    level = 0
    while True:
        # The first level is still distributed as its aggregation left it; the number of rows is known afterwards
        count = None if level == 0 else rows.where("mark = 'self'").count()
        if count == 0:
            break
        last = count is not None and count <= most
        # Every second level bridges; the first and the last only unite
        bridge = not last and level % 2 == 1
        if level:
            rows = rows.where("mark in ('self', 'kid', 'over')").repartition(1 if last else -(-count // most), "node")
        done = checkpointed(rows.mapInPandas(_forest(level, bridge, last, named), _STATE.format(listed)))
        levels.append(done)
        rows, level = done, level + 1
        if last:
            break
    known = None
    for at in range(len(levels) - 1, -1, -1):
        done = levels[at]
        tops = done.where("mark = 'top'").select(
            "node", F.when(F.lit(named) | (F.col("kind") == "tree"), F.col("up")).alias("top"), F.when(F.col("kind") == "tree", zero).otherwise(F.lit(-1).cast("long")).alias("depth"),
            F.col("under").alias("n_desc"), "kind", (F.array("node") if named else empty).alias("path"),
        )
        whole = tops if known is None else known.union(tops)
        known = whole.union(_expanded(done, whole, named, "under"))
        if at >= 2 and at % 2 == 0:  # nodes bridged in the level before hang on children that may be united in this one
            known = checkpointed(known)
            known = known.union(_expanded(done, known, named, "above"))
        if at:
            known = checkpointed(known)
    return known


def hierarchies(links: DataFrame, local: int | None = None) -> DataFrame:
    """One row for each node of links (parent, child): its root, depth, descendants and kind.

    Returns node_key, root_node, node_depth, n_desc and node_kind: 'tree' with the topmost node and
    the links from it; 'cycle' for nodes on a loop and 'below' for nodes that hang under one, both
    with root_node '' and node_depth -1. n_desc counts the other nodes that can be reached.

    Cases: repeated links count once; where a node has unlike parents, against the premise, the
    smallest key counts; rows with a null end or from a node to itself are ignored; no links give
    no rows; other columns are ignored.
    """
    tree = F.col("kind") == "tree"
    return resolved(links, False, local).select(
        F.col("node").alias("node_key"), F.when(tree, F.col("top")).otherwise("").alias("root_node"), F.col("depth").alias("node_depth"), "n_desc", F.col("kind").alias("node_kind")
    )


def paths(links: DataFrame, local: int | None = None) -> DataFrame:
    """(node_key, path) with the nodes from the root down to the node, of all nodes in trees.

    Nodes on or below loops have no path and are left out. A path's length is its output; nothing
    longer is made on the way.
    """
    return resolved(links, True, local).where("kind = 'tree'").select(F.col("node").alias("node_key"), "path")


def descendants(links: DataFrame, local: int | None = None) -> DataFrame:
    """(node_key, descendant) for each node and each other node that can be reached from it.

    Rows are made from the descendants' side, by unfolding their paths, so the descendants of a node
    are spread as the nodes are and never form a group. What hangs on a loop is reached from all of
    the loop, by a join on the loop. Cases: as in hierarchies.
    """
    found = checkpointed(resolved(links, True, local))
    above = found.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("node_key"), F.col("node").alias("descendant"))
    ring = found.where("kind = 'cycle'").select("top", F.col("node").alias("node_key"))
    loose = found.where("kind <> 'tree'").select("top", F.col("path")[0].alias("entry"), F.col("node").alias("descendant"))
    return above.union(loose.join(ring, "top").where("node_key <> entry").select("node_key", "descendant"))
