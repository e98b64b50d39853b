"""History of changing attributes: a bitemporal ledger and the versions that hold now.

Every row of the feed says that an entity has a state from a valid date on, and was recorded at a
time. The ledger has one row for each state, valid period and recorded period in which the engine
would have given just that answer; nothing is overwritten, a late row closes the recorded period of
the rows it supersedes.

How it is distributed
  * Rows of one entity, date and recorded time are reduced first, with map-side combining, so sent
    again rows of a hot entity never meet in one task.
  * The states of one date are a window over (entity, date).
  * Where a date's validity ends depends only on the entity's dates and on when each was first
    known. This table has at most one row for each entity and calendar date, which bounds the group
    that a sweep-line holds, however many rows an entity has.
  * Both are joined on (entity, date) and the recorded periods intersected.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Given to rows without a recorded time: they count as known before all others.
DAWN = "0001-01-01 00:00:00"
#: The open end of a valid period.
OPEN_DATE = "9999-12-31"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid ends by recorded period, of rows sorted by entity, first recorded time and date.

    For each entity the sweep goes through recorded time. A new date splits the period that covers
    it: the date before gets a new end, and its former end is closed at this recorded time.
    """
    out: list[tuple] = []
    entity, dates, live = None, [], {}

    def close() -> None:
        for day, (since, end) in live.items():
            out.append((entity, day, since, None, end))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
            names=["entity", "day", "known_from", "known_to", "end_day"],
        )
        out.clear()
        return made

    for b in batches:
        for who, known, day in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if who != entity:
                close()
                entity, dates, live = who, [], {}
            at = bisect_left(dates, day)
            if at:
                before = dates[at - 1]
                since, end = live[before]
                if since < known:
                    out.append((entity, before, since, known, end))
                live[before] = (known, day)
            live[day] = (known, dates[at] if at < len(dates) else None)
            dates.insert(at, day)
        if len(out) > 20_000:
            yield batch()
    close()
    yield batch()


def bitemporal_ledger(
    feed: DataFrame,
    entity: str,
    attributes: list[str],
    valid_from: str,
    recorded_at: str,
    tie: str,
    removed: str,
) -> DataFrame:
    """The bitemporal ledger of a feed of updates and snapshots.

    entity, valid_from (date), recorded_at (timestamp) and tie (a number) name columns of feed;
    removed is a SQL condition that holds for rows which end the entity.
    Returns entity, attributes, removed, valid_from, valid_to, recorded_from, recorded_to. Ends are
    exclusive and null where open; recorded_from is DAWN where the feed has no recorded time.

    Cases: rows with null entity or date are ignored, as they place nothing in time; of rows with
    equal entity, date and recorded time the largest tie counts; rows that repeat the state known
    for their date change nothing; null attributes are values and equal one another; an empty feed
    gives an empty ledger; other columns of the feed are ignored, whatever their names.
    """
    key = F.col(entity).cast("string")
    rows = feed.where(F.col(entity).isNotNull() & F.col(valid_from).isNotNull()).select(
        key.alias("entity"),
        F.datediff(F.col(valid_from).cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
        F.unix_micros(F.coalesce(F.col(recorded_at).cast("timestamp"), F.lit(DAWN).cast("timestamp"))).alias("known"),
        F.coalesce(F.col(tie).cast("long"), F.lit(-(2**63))).alias("tie"),
        F.struct(F.coalesce(F.expr(removed), F.lit(False)).alias("removed"), *[F.col(a) for a in attributes]).alias("state"),
    )
    cells = rows.groupBy("entity", "day", "known").agg(F.max_by("state", "tie").alias("state"))
    order = Window.partitionBy("entity", "day").orderBy("known")
    states = (
        cells.withColumn("before", F.lag(F.struct("state")).over(order))
        .where(F.col("before").isNull() | ~F.col("before.state").eqNullSafe(F.col("state")))
        .withColumn("until", F.lead("known").over(order))
        .drop("before")
    )
    first = rows.groupBy("entity", "day").agg(F.min("known").alias("known"))
    ends = (
        first.select("entity", "known", "day")
        .repartition("entity")
        .sortWithinPartitions("entity", "known", "day")
        .mapInArrow(_sweep, "entity string, day int, known_from long, known_to long, end_day int")
    )
    cut = (
        states.join(ends, ["entity", "day"])
        .withColumn("recorded_from", F.greatest("known", "known_from"))
        .withColumn("recorded_to", F.least("until", "known_to"))
        .where(F.col("recorded_to").isNull() | (F.col("recorded_from") < F.col("recorded_to")))
    )
    kind = feed.schema[entity].dataType
    return cut.select(
        F.col("entity").cast(kind).alias(entity),
        *[F.col(f"state.{a}").alias(a) for a in attributes],
        F.col("state.removed").alias("removed"),
        F.date_from_unix_date("day").alias("valid_from"),
        F.date_from_unix_date("end_day").alias("valid_to"),
        F.timestamp_micros("recorded_from").alias("recorded_from"),
        F.timestamp_micros("recorded_to").alias("recorded_to"),
    )


def current_versions(ledger: DataFrame, entity: str, attributes: list[str]) -> DataFrame:
    """Versions held now: entity, attributes, valid_from, valid_to (exclusive, null if open).

    Takes the rows of a ledger whose recorded period is open, joins neighbours with equal states to
    one version and leaves out the periods in which the entity is removed. The window over an entity
    holds at most one row for each calendar date.
    """
    order = Window.partitionBy(entity).orderBy("valid_from")
    state = F.struct("removed", *attributes)
    return (
        ledger.where(F.col("recorded_to").isNull())
        .select(entity, *attributes, "removed", "valid_from")
        .withColumn("state", state)
        .withColumn("before", F.lag(F.struct("state")).over(order))
        .where(F.col("before").isNull() | ~F.col("before.state").eqNullSafe(F.col("state")))
        .withColumn("valid_to", F.lead("valid_from").over(order))
        .where(~F.col("removed"))
        .select(entity, *attributes, "valid_from", "valid_to")
    )


def as_of(ledger: DataFrame, valid_on: str, known_at: str) -> DataFrame:
    """The states that, as known at known_at (timestamp text), held on valid_on (date text)."""
    day, time = F.lit(valid_on).cast("date"), F.lit(known_at).cast("timestamp")
    return ledger.where(
        ~F.col("removed")
        & (F.col("valid_from") <= day)
        & (F.col("valid_to").isNull() | (F.col("valid_to") > day))
        & (F.col("recorded_from") <= time)
        & (F.col("recorded_to").isNull() | (F.col("recorded_to") > time))
    )
