"""Sentences that say what tasks and components do, and views for drilling into a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import etl
from weftline.operators.lineage import label, text
from weftline.operators.schedule import usual_type

# What each operation does to its target.
VERBS = [("MERGE", "synchronizes"), ("DELETE", "removes rows from"), ("UPDATE", "updates"), ("SELECTINTO", "creates"), ("INSERT", "loads"), ("DERIVED", "derives columns of"), ("LOOKUP", "looks up references for")]


def verb(operation: Column) -> Column:
    """What an operation does, by the first of VERBS that it names."""
    out = None
    for word, does in VERBS:
        hit = F.upper(operation).contains(word)
        out = F.when(hit, does) if out is None else out.when(hit, does)
    return out.otherwise("moves data to")


def task_narratives(maps: DataFrame, glossary: dict[str, str] | None = None) -> DataFrame:
    """(package_id, task_id, narrative): one sentence a task, with all its tables in business terms, in order."""
    terms = glossary or etl.GLOSSARY
    name = lambda s: etl.translate(label(text(f"{s}_schema"), text(f"{s}_table")), terms)
    sides = maps.groupBy("package_id", "task_id", name("source").alias("s"), name("target").alias("t"), verb(text("operation_type")).alias("v")).agg(F.count("*").alias("n"))
    listed = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    grouped = sides.groupBy("package_id", "task_id").agg(listed("s").alias("s"), listed("t").alias("t"), F.array_sort(F.collect_set("v")).alias("v"), F.sum("n").alias("n"))
    shown = lambda c: F.array_join(c, ", ")
    said = F.concat(F.lit("This task "), F.array_join("v", " and "), F.lit(" "), shown("t"), F.when(F.size("s") > 0, F.concat(F.lit(" from "), shown("s"))).otherwise(""), F.lit(", "), F.col("n").cast("string"), F.lit(" column mappings."))
    return grouped.select("package_id", "task_id", said.alias("narrative"))


# What each component of a data flow is for.
PARTS = {"Lookup": "matches rows with a reference", "Derived Column": "computes columns", "Aggregate": "summarizes rows by SUM, COUNT, AVG, MIN or MAX", "Sort": "puts rows in order", "Conditional Split": "routes rows by conditions", "Union All": "combines inputs", "OLE DB Source": "reads rows", "OLE DB Destination": "writes rows", "Script Component": "runs custom code"}


def component_narratives(components: DataFrame) -> DataFrame:
    """(component_id, narrative) of components (component_id, name, type)."""
    does = F.create_map(*[x for k, v in PARTS.items() for x in (F.lit(k), F.lit(v))])
    return components.select("component_id", F.concat(text("name"), F.lit(" "), F.coalesce(F.try_element_at(does, F.col("type")), F.lit("transforms rows")), F.lit(".")).alias("narrative"))


def task_recommendations(tasks: DataFrame) -> DataFrame:
    """(task_id, usual_type, recommendation) of tasks (task_id, type)."""
    return tasks.select("task_id", usual_type(F.col("type")).alias("usual_type"), etl.task_advice(usual_type(F.col("type"))).alias("recommendation"))


def drill_down(maps: DataFrame, most: int = 500, **where: str) -> DataFrame:
    """Distinct (source, target, operation) of the maps of a package, task or component, in order.

    where names columns and values; a component id also takes ids qualified with it. most is the
    view's length.
    """
    rows = maps
    for column, value in where.items():
        rows = rows.where((F.col(column) == value) | F.col(column).startswith(f"{value}::"))
    full = lambda s: label(text(f"{s}_schema"), text(f"{s}_table"), text(f"{s}_column"))
    return rows.select(full("source").alias("source"), full("target").alias("target"), "operation_type").distinct().orderBy("source", "target", "operation_type").limit(most)


def complete(maps: DataFrame, start: str, table: str | None = None, most: int = 20) -> DataFrame:
    """Names to choose from that hold a text: tables, or the columns of a table, in order."""
    sides = []
    for s in ("source", "target"):
        name = label(text(f"{s}_schema"), text(f"{s}_table"))
        rows = maps if table is None else maps.where(F.lower(name) == table.lower())
        sides.append(rows.select((name if table is None else text(f"{s}_column")).alias("choice")))
    found = sides[0].union(sides[1]).where((F.col("choice") != "") & F.lower("choice").contains(start.lower()))
    return found.distinct().orderBy(F.lower("choice"), "choice").limit(most)


def effort(components: DataFrame) -> DataFrame:
    """(package_id, n_components, person_days, size): days are 1.5 a component, at least 1."""
    days = F.greatest(F.lit(1), F.floor(F.col("n_components") * 1.5).cast("int"))
    size = F.when(days <= 5, "S").when(days <= 15, "M").when(days <= 40, "L").otherwise("XL")
    return components.groupBy("package_id").agg(F.count("*").alias("n_components")).select("package_id", "n_components", days.alias("person_days"), size.alias("size"))
