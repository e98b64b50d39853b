"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The total is cut into blocks of equal token counts. Blocks go to sources one after another, each to
the source with the highest quotient share / (2 k + 1) for its k blocks so far. A source's blocks go
on to its shards in the same way, in proportion to their tokens, which gives each shard an integer
quota. Within a shard the documents stand in seeded order; the quota is met by whole passes over the
shard and the leading blocks of one more pass.

What reaches the driver is one row for each target, MAX_TARGETS at most, and one for each shard, that is
for each SHARD_TOKENS tokens: about a million rows for 20 trillion tokens. The table of quotas is left to
Spark to broadcast by its size. A source with a third of all documents is split over its shards; the windows that order
documents run within one shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpointed

#: Blocks that the total is cut into: shares come out to within about one of this many parts.
BLOCKS = 100_000
#: Tokens of a shard, and the blocks that one is cut into at least.
SHARD_TOKENS, SHARD_BLOCKS = 20_000_000, 64
#: The most rows that the table of targets may have.
MAX_TARGETS = 10_000


def sainte_lague(weights: list[float], seats: int, limits: list[int] | None = None) -> list[int]:
    """Seats for each weight by highest quotients weight / (2 k + 1), none above its limit.

    Ties go to the earlier weight. Weights of zero or less get none; seats that no one may take stay
    empty. Parties start with the seats that any apportionment of so many seats gives them, so only
    a few seats for each party are dealt one by one.
    """
    n = len(weights)
    limits = [seats] * n if limits is None else limits
    total = sum(w for w in weights if w > 0)
    safe = max(0, seats - n)
    given = [min(lim, int(w / total * safe + 0.5)) if w > 0 else 0 for w, lim in zip(weights, limits, strict=True)]
    left = seats - sum(given)
    queue = [(-w / (2 * k + 1), at, k) for at, (w, k, lim) in enumerate(zip(weights, given, limits, strict=True)) if w > 0 and k < lim]
    heapq.heapify(queue)
    while left > 0 and queue:
        _, at, k = heapq.heappop(queue)
        given[at] = k + 1
        left -= 1
        if k + 1 < limits[at]:
            heapq.heappush(queue, (-weights[at] / (2 * k + 3), at, k + 1))
    return given


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix and the shares that it reaches.

    documents has doc_id, source and n_tokens; targets has source, target_share and max_copies.
    total_tokens is the size of the mix; by default the largest at which no source has to repeat its
    documents more often than it may.
    Returns (doc_id, source, n_tokens, copies) with copies >= 1, and (source, target_share,
    n_docs, tokens_held, tokens_used, actual_share, docs_used, most_copies) of each target.

    Cases: documents without a source, of sources without a target, or without tokens are left out;
    targets without documents or with a null or non-positive share get nothing, and the shares of
    the others are raised in proportion; null max_copies counts as 1; of repeated targets the first
    by share and copies counts; if total_tokens is more than the sources may give, those at their
    limit stay there and the shares reached say so; no documents give an empty mix.
    """
    spark = documents.sparkSession
    rows = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_copies")).alias("t")).select("source", "t.*").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    goal = {r["source"]: (max(0.0, r["target_share"] or 0.0), r["target_share"], max(0, 1 if r["max_copies"] is None else r["max_copies"])) for r in rows}
    names = spark.createDataFrame([(s,) for s in goal], "source string")
    sized = checkpointed(
        documents.join(F.broadcast(names), "source", "left_semi").where("n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"))
    )
    held = {r["source"]: (r["n"], r["t"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    able = sorted(s for s in held if goal[s][0] > 0 and goal[s][2] > 0)
    whole = sum(goal[s][0] for s in able)
    most = {s: goal[s][2] * held[s][1] for s in able}
    total = total_tokens or (int(min(most[s] * whole / goal[s][0] for s in able)) if able else 0)
    block = max(1, min(total // BLOCKS, SHARD_TOKENS // SHARD_BLOCKS))
    counts = sainte_lague([goal[s][0] for s in able], total // block, [most[s] // block for s in able]) if able else []
    shards = {s: max(1, -(-held[s][1] // SHARD_TOKENS)) for s in able}
    split = spark.createDataFrame([(s, shards[s]) for s in able], "source string, n_shards int")  # MAX_TARGETS rows at most
    placed = sized.join(F.broadcast(split), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_shards")).cast("int")).drop("n_shards")
    quotas = []
    sizes: dict[str, list[tuple[int, int]]] = {s: [] for s in able}
    for r in placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).collect():
        sizes[r["source"]].append((r["shard"], r["t"]))
    for s, blocks in zip(able, counts, strict=True):
        own = sorted(sizes[s])
        dealt = sainte_lague([float(t) for _, t in own], blocks, [-(-goal[s][2] * t // block) for _, t in own])
        quotas += [(s, shard, t, min(k * block, goal[s][2] * t)) for (shard, t), k in zip(own, dealt, strict=True)]
    quota = spark.createDataFrame(quotas, "source string, shard int, shard_tokens long, quota long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    passes = F.expr("quota div shard_tokens")
    mixed = (
        placed.join(quota, ["source", "shard"])
        .withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
        .withColumn("copies", passes + (F.col("before") + F.col("n_tokens") / 2 <= F.col("quota") - passes * F.col("shard_tokens")).cast("long"))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"))
    base = spark.createDataFrame(
        [(s, goal[s][1], held.get(s, (0, 0))[0], held.get(s, (0, 0))[1]) for s in goal], "source string, target_share double, n_docs long, tokens_held long"
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    everything = F.sum("tokens_used").over(Window.partitionBy())  # over the targets alone
    shares = (
        base.join(used, "source", "left")
        .withColumn("all_tokens", everything)
        .select("source", "target_share", "n_docs", "tokens_held", zero("tokens_used"), F.coalesce(F.col("tokens_used") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("docs_used"), zero("most_copies"))
    )
    return mixed, shares

