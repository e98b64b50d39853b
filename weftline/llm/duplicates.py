"""Duplicates hidden by formatting: one representative and an exact copy count for each record.

Method: each record gets a canonical text; the texts are range-partitioned together with their ids
and sorted externally, so equal records lie next to one another, the smallest id first. A scan then
compares each full text with the one before it and gives every record the head of its run.

A run may be cut by a partition's edge; a record that makes up a third of all rows is spread over
many partitions in this way and never meets one task. Each partition therefore also gives the texts
of its first and last run with their heads, two rows at most, and runs that continue are joined by
the smallest head. This table has two rows for each partition, so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import alnum_key
from weftline.session import checkpointed

#: Between the fields of a canonical text; no letter or digit, so no field holds it.
BETWEEN = "\x1f"


def list_key(column: Column) -> Column:
    """The key of a list 'A | B': the keys of its parts in order, without empty parts."""
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), r"\|"), alnum_key)
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), "|")


def canonical(fields: list[Column], lists: frozenset[int] = frozenset()) -> Column:
    """The canonical text of a record.

    Only letters, digits and their order within a field count; letter case, punctuation and white
    space don't. Null, empty and blank fields are equal; letters with accents differ from those
    without. lists has, by position, the fields that hold a '|' list, whose parts may stand in any
    order. The position of a field in the source, as in JSON or Name=Value lists, is up to the
    caller, who names the fields.
    """
    keys = [list_key(f) if n in lists else alnum_key(f) for n, f in enumerate(fields)]
    return F.concat_ws(BETWEEN, *keys)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in a sorted partition of (kind, text, id).

    Gives (kind, head, id, text) with text null for each row that isn't its run's head, and for the
    first and last run of the partition (kind, head, null, text).
    """
    names = ["kind", "head", "id", "text"]
    kind_type, text_type = pa.string(), pa.string()
    last_text = last_kind = head = None
    edge: list[tuple] = []

    def made(kinds: pa.Array, heads: pa.Array, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([kinds, heads, ids, texts], names=names)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        kinds, texts = b.column(0).cast(kind_type), b.column(1).cast(text_type)
        ids = b.column(2).to_numpy(zero_copy_only=False)
        begins = np.ones(n, bool)
        begins[1:] = pc.or_(pc.not_equal(texts.slice(1), texts.slice(0, n - 1)), pc.not_equal(kinds.slice(1), kinds.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        begins[0] = texts[0].as_py() != last_text or kinds[0].as_py() != last_kind
        if last_text is None:
            edge.append((kinds[0].as_py(), int(ids[0]), texts[0].as_py()))
        at = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        heads = np.where(at >= 0, ids[np.maximum(at, 0)], head if head is not None else 0)
        last_text, last_kind, head = texts[n - 1].as_py(), kinds[n - 1].as_py(), int(heads[-1])
        copies = pa.array(~begins)
        yield made(kinds.filter(copies), pa.array(heads).filter(copies), pa.array(ids).filter(copies), pa.nulls(int((~begins).sum()), text_type))
    if last_text is not None:
        edge.append((last_kind, head, last_text))
        k, h, t = zip(*edge, strict=True)
        yield made(pa.array(k, kind_type), pa.array(h, pa.int64()), pa.nulls(len(edge), pa.int64()), pa.array(t, text_type))


def copies(records: DataFrame) -> DataFrame:
    """(kind, head, id) of every row of records (kind, text, id) that isn't its group's first.

    Rows are copies when kind and text are equal; head is the smallest id of the group. Ids are
    bigint and not null.

    Cases: rows with null kind, text or id are left out; an empty text is a text; equal ids in a
    group are copies of one another; no rows give no rows; other columns are ignored.
    """
    usable = records.where("kind is not null and text is not null and id is not null").select("kind", "text", F.col("id").cast("long").alias("id"))
    scanned = checkpointed(
        usable.repartitionByRange("text", "kind", "id").sortWithinPartitions("text", "kind", "id").mapInArrow(_runs, "kind string, head long, id long, text string")
    )
    edges = scanned.where("id is null").groupBy("kind", "text").agg(F.min("head").alias("first"), F.collect_set("head").alias("heads"))
    moved = edges.select("kind", F.explode("heads").alias("head"), "first").where("head <> first")
    # A head that isn't the first of its whole run becomes a copy itself
    found = scanned.where("id is not null").select("kind", "head", "id").union(moved.select("kind", F.col("head"), F.col("head")))
    return found.join(F.broadcast(moved), ["kind", "head"], "left").select("kind", F.coalesce("first", "head").alias("head"), "id")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, head, n, text) of the runs of a sorted partition; text is null but for the first and last run."""
    names = ["kind", "head", "n", "text"]
    run: tuple | None = None
    fresh = True  # the first run isn't closed yet
    whole = lambda kind, text, head, n: pa.RecordBatch.from_arrays([pa.array([kind], pa.string()), pa.array([head], pa.int64()), pa.array([n], pa.int64()), pa.array([text], pa.string())], names=names)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        kinds, texts = b.column(0).cast(pa.string()), b.column(1).cast(pa.string())
        ids = b.column(2).to_numpy(zero_copy_only=False)
        begins = np.ones(n, bool)
        begins[1:] = pc.or_(pc.not_equal(texts.slice(1), texts.slice(0, n - 1)), pc.not_equal(kinds.slice(1), kinds.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        begins[0] = run is None or texts[0].as_py() != run[1] or kinds[0].as_py() != run[0]
        starts = np.flatnonzero(begins)
        if run is not None:
            run = (*run[:3], run[3] + int(starts[0] if len(starts) else n))
            if not len(starts):
                continue
            yield whole(*run) if fresh else whole(run[0], None, run[2], run[3])
            fresh = False
        closed, counts = starts[:-1], np.diff(starts)
        if fresh and len(closed):
            yield whole(kinds[int(closed[0])].as_py(), texts[int(closed[0])].as_py(), int(ids[closed[0]]), int(counts[0]))
            closed, counts, fresh = closed[1:], counts[1:], False
        yield pa.RecordBatch.from_arrays([kinds.take(pa.array(closed)), pa.array(ids[closed]), pa.array(counts), pa.nulls(len(closed), pa.string())], names=names)
        last = int(starts[-1])
        run = (kinds[last].as_py(), texts[last].as_py(), int(ids[last]), n - last)
    if run is not None:
        yield whole(*run)


def groups(records: DataFrame) -> DataFrame:
    """(kind, head, n_copies): the representative of each group of equal records and its size.

    Groups of one row are included. The scan knows the length of each run, so only the first and last
    runs of partitions, two rows each, are grouped once more. Cases: as in copies.
    """
    usable = records.where("kind is not null and text is not null and id is not null").select("kind", "text", F.col("id").cast("long").alias("id"))
    scanned = checkpointed(
        usable.repartitionByRange("text", "kind", "id").sortWithinPartitions("text", "kind", "id").mapInArrow(_sizes, "kind string, head long, n long, text string")
    )
    joined = scanned.where("text is not null").groupBy("kind", "text").agg(F.min("head").alias("head"), F.sum("n").alias("n_copies"))
    return scanned.where("text is null").select("kind", "head", F.col("n").alias("n_copies")).union(joined.select("kind", "head", "n_copies"))


def payload_field(payload: Column, name: str) -> Column:
    """A field of a JSON object or of a list 'Name=Value; ...', null where it is missing.

    A payload that is neither gives null. The list may have white space around names and values.
    """
    listed = F.regexp_extract(payload, rf"(?:^|;)[\s ]*{name}[\s ]*=([^;]*)", 1)
    return F.when(payload.rlike(r"^[\s ]*\{"), F.get_json_object(payload, f"$.{name}")).otherwise(listed)


def map_records(column_map: DataFrame, map_export: DataFrame) -> DataFrame:
    """The records of both tables as (kind, text, id): kind 'map' or 'export'.

    Rows without a letter or digit in the source column are left out.
    """
    names = ["SourceSchema", "SourceTable", "SourceColumnName", "TargetTable"]
    maps = column_map.select(F.lit("map").alias("kind"), F.col("map_id").alias("id"), *[F.col(c).alias(n) for c, n in zip(["source_schema", "source_table", "source_column_name", "target_table"], names, strict=True)])
    exports = map_export.select(F.lit("export").alias("kind"), F.col("export_id").alias("id"), *[payload_field(F.col("payload"), n).alias(n) for n in names])
    rows = maps.unionByName(exports)
    text = canonical([F.col(n) for n in names], frozenset({1}))
    return rows.where(F.col("SourceColumnName").rlike(r"[\p{L}\p{N}]")).select("kind", text.alias("text"), "id")
