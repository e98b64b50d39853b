"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_changes(
    rows: DataFrame,
    snapshot: str,
    keys: dict[str, Column],
    values: dict[str, Column],
    latest: list[str],
) -> DataFrame:
    """Records added, removed or changed against the snapshot before.

    snapshot names the date column. keys give the record's key and appear in the result; values are
    compared exactly, null being a value that equals itself. Of several rows for one key and
    snapshot, the one with the greatest columns named in latest counts.
    Returns snapshot (date), the keys and change_kind ('added', 'removed', 'changed').

    One aggregation shuffle on the key, with map-side combining: each row is tagged with its side,
    that is the number of its snapshot, and reduced to a 64-bit hash of its values; the group keeps
    the newest hash of each side, so a group has one entry for each snapshot, however often its rows
    were sent. The dates of the snapshots, one row each, are read first; their number is that of the
    deliveries, not of the records.

    Cases: rows without a snapshot date are ignored; rows of a key with nulls form one record for
    equal nulls; nothing is reported for the first snapshot; with fewer than two snapshots, or no
    rows, the result is empty; other columns are ignored.
    """
    day = F.col(snapshot).cast("date")
    known = [r[0] for r in rows.select(day.alias("d")).where("d is not null").distinct().orderBy("d").collect()]
    if len(known) < 2:
        return rows.limit(0).select(day.alias(snapshot), *[c.alias(k) for k, c in keys.items()], F.lit("").alias("change_kind"))
    side = F.create_map(*[x for n, d in enumerate(known) for x in (F.lit(d), F.lit(n))])
    digest = F.xxhash64(*[p for v in values.values() for p in (v.isNull(), v)])
    tagged = rows.where(day.isNotNull()).select(
        *[c.alias(f"key_{k}") for k, c in keys.items()],
        F.element_at(side, day).alias("side"),
        F.struct(*[F.col(c) for c in latest], digest.alias("digest")).alias("entry"),
    )
    grouped = tagged.groupBy(*[f"key_{k}" for k in keys]).agg(
        *[F.max(F.when(F.col("side") == n, F.col("entry"))).alias(f"side_{n}") for n in range(len(known))]
    )
    steps = []
    for n in range(1, len(known)):
        old, new = F.col(f"side_{n - 1}"), F.col(f"side_{n}")
        kind = (
            F.when(old.isNull() & new.isNotNull(), "added")
            .when(old.isNotNull() & new.isNull(), "removed")
            .when(old["digest"] != new["digest"], "changed")
        )
        steps.append(F.struct(F.lit(known[n]).cast("date").alias("day"), kind.alias("kind")))
    return (
        grouped.select(*[F.col(f"key_{k}").alias(k) for k in keys], F.explode(F.array(*steps)).alias("step"))
        .where(F.col("step.kind").isNotNull())
        .select(F.col("step.day").alias(snapshot), *keys, F.col("step.kind").alias("change_kind"))
    )
