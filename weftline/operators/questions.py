"""Questions in plain language about a lineage graph.

A question is parsed to an intent, an entity and a threshold, and the intent runs one query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import label, text

# The phrases that tell each intent, in the order in which they are tried.
PHRASES = [
    ("column_source", ["source of", "where does", "where do", "come from", "upstream", "comes from"]),
    ("column_target", ["target", "downstream", "goes to", "go to", "flows to", "destined to"]),
    ("packages_writing", ["write to", "writes to", "insert into", "load to", "save to"]),
    ("packages_reading", ["read from", "reads from", "select from", "source from"]),
    ("high_fanout", ["most used", "most referenced", "high fanout", "most downstream"]),
    ("orphans", ["no downstream", "orphan", "unused", "dead end", "no target"]),
    ("packages", ["list package", "list packages", "all packages", "show packages"]),
    ("packages_using", ["which package uses", "what package uses", "who uses column"]),
    ("mappings", ["mapping", "mapped", "column map", "lineage of", "flow of", "flow"]),
]
# Words that never name an entity.
FILLERS = set("table column the a an of in to from does do where is are have has that this ? ' \"".split())


@dataclass(frozen=True)
class Question:
    """What a question asks for."""

    original: str
    intent: str
    entity: str
    threshold: int = 2


def parse(question: str, strict: bool = False) -> Question:
    """The question's intent, entity (its longest word that isn't a phrase or filler) and threshold.

    The first intent with a phrase in the question is taken; with strict the one with the longest
    phrase, so that 'no downstream' isn't read as 'downstream'. Phrases are only removed as whole
    words, so names that hold one stay whole.
    """
    asked = (question or "").strip()
    lower = asked.lower()
    hits = [(name, max(len(p) for p in ps if p in lower)) for name, ps in PHRASES if any(p in lower for p in ps)]
    intent = (max(hits, key=lambda h: h[1]) if strict else hits[0])[0] if hits else "search"
    number = re.search(r"\b\d+\b", lower)
    rest = lower
    for phrase in sorted((p for _, ps in PHRASES for p in ps), key=len, reverse=True):
        rest = re.sub(rf"(?<![\w.]){re.escape(phrase)}(?![\w.])", " ", rest)
    words = [w for w in re.sub(r"[?'\"]", " ", rest).split() if w not in FILLERS]
    return Question(asked, intent, max(words, key=len, default=""), max(1, int(number[0])) if number else 2)


def _rows(found: DataFrame, primary: Column, secondary: Column, category: str, count: Column | None = None) -> DataFrame:
    return found.select(primary.alias("primary"), secondary.alias("secondary"), F.lit(category).alias("category"), (F.lit(1) if count is None else count).cast("long").alias("n"))


def _side(maps: DataFrame, side: str, full: bool = True) -> Column:
    return label(text(f"{side}_schema"), text(f"{side}_table"), *([text(f"{side}_column")] if full else []))


def _entity(side: str, entity: str) -> Column:
    return F.lower(text(f"{side}_column")).contains(entity) | F.lower(text(f"{side}_table")).contains(entity)


def _table(side: str, entity: str) -> Column:
    return (F.lower(label(text(f"{side}_schema"), text(f"{side}_table"))) == entity) | F.lower(text(f"{side}_table")).contains(entity)


def column_ends(maps: DataFrame, entity: str, other: str) -> DataFrame:
    """The columns at the other end ('source' or 'target') of maps whose near end matches entity."""
    near = "target" if other == "source" else "source"
    found = maps.where(_entity(near, entity.lower())).select(_side(maps, other).alias("p"), F.concat_ws(" / ", "package_id", "task_id").alias("s")).distinct()
    return _rows(found, F.col("p"), F.col("s"), other.capitalize())


def packages_at(maps: DataFrame, entity: str, side: str) -> DataFrame:
    """Packages that write (target) or read (source) a table, with their tasks and number of maps."""
    found = maps.where(_table(side, entity.lower())).groupBy("package_id").agg(F.array_join(F.array_sort(F.collect_set("task_id")), ", ").alias("tasks"), F.count("*").alias("n"))
    return _rows(found, F.col("package_id"), F.col("tasks"), "Writer" if side == "target" else "Reader", F.col("n"))


def packages_using(maps: DataFrame, entity: str) -> DataFrame:
    """Packages with maps that name the column on either side."""
    named = (F.lower(text("source_column")) == entity.lower()) | (F.lower(text("target_column")) == entity.lower())
    found = maps.where(named).groupBy("package_id").agg(F.array_join(F.array_sort(F.collect_set("task_id")), ", ").alias("tasks"), F.count("*").alias("n"))
    return _rows(found, F.col("package_id"), F.col("tasks"), "Package", F.col("n"))


def high_fanout(maps: DataFrame, least: int, most: int = 30) -> DataFrame:
    """Source columns with at least so many maps, the most first; most is the report's length."""
    found = maps.where(text("source_column") != "").groupBy(_side(maps, "source").alias("p")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return _rows(found, F.col("p"), F.lit(""), "High Fanout", F.col("n")).orderBy(F.desc("n"), "primary").limit(most)


def orphans(maps: DataFrame) -> DataFrame:
    """Tables that are written and never read."""
    written = maps.where(text("target_table") != "").select(F.lower(_side(maps, "target", False)).alias("p")).distinct()
    read = maps.where(text("source_table") != "").select(F.lower(_side(maps, "source", False)).alias("p")).distinct()
    return _rows(written.join(read, "p", "left_anti"), F.col("p"), F.lit(""), "Orphan")


def package_inventory(maps: DataFrame) -> DataFrame:
    """Each package with its tasks and maps."""
    found = maps.groupBy("package_id").agg(F.count_distinct("task_id").alias("t"), F.count("*").alias("n"))
    return _rows(found, F.col("package_id"), F.concat(F.col("t").cast("string"), F.lit(" tasks")), "Package", F.col("n"))


def table_mappings(maps: DataFrame, entity: str, most: int = 100) -> DataFrame:
    """Distinct maps of a table or column, in order; most is the report's length."""
    found = maps.where(_entity("source", entity.lower()) | _entity("target", entity.lower())).select(_side(maps, "source").alias("p"), _side(maps, "target").alias("s"), "operation_type").distinct()
    return found.select(F.col("p").alias("primary"), F.col("s").alias("secondary"), F.col("operation_type").alias("category"), F.lit(1).cast("long").alias("n")).orderBy("primary", "secondary", "category").limit(most)


def answer(maps: DataFrame, question: str, strict: bool = False) -> DataFrame:
    """(primary, secondary, category, n) for a question; where its query finds nothing, a search."""
    q = parse(question, strict)
    queries: dict[str, Callable[[], DataFrame]] = {
        "column_source": lambda: column_ends(maps, q.entity, "source"),
        "column_target": lambda: column_ends(maps, q.entity, "target"),
        "packages_writing": lambda: packages_at(maps, q.entity, "target"),
        "packages_reading": lambda: packages_at(maps, q.entity, "source"),
        "high_fanout": lambda: high_fanout(maps, q.threshold),
        "orphans": lambda: orphans(maps),
        "packages": lambda: package_inventory(maps),
        "packages_using": lambda: packages_using(maps, q.entity),
    }
    found = queries.get(q.intent, lambda: table_mappings(maps, q.entity))()
    return found if q.intent == "search" or found.take(1) else table_mappings(maps, q.entity, 50)
