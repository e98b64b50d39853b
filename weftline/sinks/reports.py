"""Reports of risk, proposed changes and differences as Markdown, full CSV exports, graphs as JSON, archives.

Reports are DataFrames of lines like the other exports; a report's length is that of its result.
"""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import etl
from weftline.operators import lineage as L
from weftline.operators.lineage import label, text
from weftline.operators.resolve import impact_counters
from weftline.sinks.exports import _lines, _one, csv_text

# The columns of both CSV exports, in order.
LINEAGE_COLUMNS = (
    "Step,Package,Task,Procedure,SourceServer,SourceDatabase,SourceSchema,SourceTable,SourceColumn,SourceExpression,"
    "TargetServer,TargetDatabase,TargetSchema,TargetTable,TargetColumn,OperationType,FilterConditions,JoinCondition"
).split(",")
TRACE_COLUMNS = (
    "Step,SourceServer,SourceDatabase,SourceSchema,SourceTable,SourceColumn,Operation,Rename,Expression,FilterConditions,"
    "TargetServer,TargetDatabase,TargetSchema,TargetTable,TargetColumn,Package,Task,Procedure,JoinCondition"
).split(",")
# Levels of risk with their points, severities in their order, kinds of differences.
LEVELS = [("Critical", "75 and more"), ("High", "50-74"), ("Medium", "25-49"), ("Low", "0-24")]
SEVERITIES = ["Critical", "Warning", "Info"]
KINDS = [("package", "Packages"), ("task", "Tasks"), ("component", "Components"), ("mapping", "Column mappings")]


def _cell(c: Column) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(c) for c in cells]), F.lit(" |"))


def risk_recommendation(scores: DataFrame) -> DataFrame:
    """(table_name, recommendation) by the level of each table's risk."""
    text_of = (
        F.when(F.col("level") == "Critical", F.concat(F.lit("Put a view or staging model before "), F.col("table_name"), F.lit(" so that its "), F.col("downstream_tables").cast("string"), F.lit(" downstream tables are decoupled before the schema changes.")))
        .when(F.col("level") == "High", F.concat(F.lit("Simulate changes of "), F.col("table_name"), F.lit(" before altering types; "), F.col("reader_packages").cast("string"), F.lit(" packages read it.")))
        .when(F.col("level") == "Medium", F.concat(F.lit("Check the models that refer to "), F.col("table_name"), F.lit(" when its packages are migrated.")))
        .otherwise(F.concat(F.col("table_name"), F.lit(" can be changed with the usual tests.")))
    )
    return scores.select("table_name", text_of.alias("recommendation"))


def risk_markdown(scores: DataFrame) -> DataFrame:
    """The risk report: number of tables by level, average, and the tables by score, then name."""
    counts = scores.agg(*[F.count_if(F.col("level") == n).alias(n) for n, _ in LEVELS], F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("mean"))
    rows = F.array(*[F.struct(F.lit(k).alias("rank"), _row(F.lit(f"{n} ({p})"), F.col(n)).alias("line")) for k, (n, p) in enumerate(LEVELS)], F.struct(F.lit(4).alias("rank"), _row(F.lit("Average score"), F.col("mean")).alias("line")))
    order = F.row_number().over(L.Window.orderBy(F.desc("score"), "table_name"))  # one row a table of the catalogue
    table = scores.select(order.alias("rank"), _row(F.col("table_name"), F.col("score"), F.col("level"), F.col("downstream_tables"), F.col("depth"), F.col("reader_packages"), F.col("mapping_count")).alias("line"))
    return _lines([
        _one(scores, "# Risk report", "", "## Summary", "", "| Level | Count |", "|---|---|"), counts.select(F.inline(rows)),
        _one(scores, "", "## Tables", "", "| Table | Score | Level | Fan-out | Depth | Shared by | Mappings |", "|---|---|---|---|---|---|---|"), table,
    ])


def whatif_markdown(findings: DataFrame, steps: DataFrame, change: str, table: str, column: str = "", new: str = "") -> DataFrame:
    """The report of a proposed change: counters, findings by severity, then the checklist in order.

    findings and steps are those of impact() and checklist().
    """
    what = f"{table}.{column}" if column else table
    said = {"drop_column": f"Drop **{what}**", "rename_column": f"Rename **{what}** to `{new}`", "drop_table": f"Drop table **{what}**", "rename_table": f"Rename table **{what}** to `{new}`", "change_type": f"Change the type of **{what}** to `{new}`"}[change]
    names = [("Affected packages", "packages"), ("Broken column mappings", "mappings"), ("Stored procedures to review", "procedures"), ("Tasks affected", "tasks")]
    counters = impact_counters(findings).select(F.inline(F.array(*[F.struct(F.lit(k).alias("rank"), _row(F.lit(n), F.col(c)).alias("line")) for k, (n, c) in enumerate(names)])))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")).cast("int")
    listed = findings.select(rank.alias("rank"), _row(F.col("severity"), F.col("category"), F.concat_ws(" / ", "package_id", "task_id"), F.concat_ws(" ", "side", "other")).alias("line"))
    todo = steps.select(F.col("priority").alias("rank"), F.concat(F.when(F.col("priority") == 1, "- **[Required]** ").otherwise("- *[Recommended]* "), F.col("action"), F.lit(" `"), F.col("target"), F.lit("`")).alias("line"))
    return _lines([
        _one(findings, "# What-if simulation", "", "## Proposed changes", "", f"- {said}", "", "## Impact summary", "", "| Metric | Count |", "|---|---|"), counters,
        _one(findings, "", "## Findings", "", "| Severity | Category | Location | Description |", "|---|---|---|---|"), listed, _one(findings, "", "## Checklist", ""), todo,
    ])


def diff_markdown(diff: DataFrame) -> DataFrame:
    """The differences of graph_diff in eight sections, each in order without letter case; empty ones are left out."""
    counted = diff.groupBy("kind", "change").agg(F.count("*").alias("n"))
    place = None
    title = None
    for k, (kind, plural) in enumerate(KINDS):
        for n, change in enumerate(("added", "removed")):
            hit = (F.col("kind") == kind) & (F.col("change") == change)
            place = F.when(hit, 2 * k + n) if place is None else place.when(hit, 2 * k + n)
            title = F.when(hit, f"{plural} {change}") if title is None else title.when(hit, f"{plural} {change}")
    heads = counted.select(place.alias("at"), F.lit(0).alias("what"), F.lit("").alias("key"), F.concat(F.lit("## "), title, F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    items = diff.select(place.alias("at"), F.lit(1).alias("what"), F.lower("key").alias("key"), F.concat(F.lit("- "), F.col("key")).alias("line"))
    ranked = heads.union(items).select((F.row_number().over(L.Window.partitionBy("at").orderBy("what", "key", "line")) + F.col("at").cast("long") * (1 << 40)).alias("rank"), "line")
    total = diff.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("rank"), F.when(F.col("n") == 0, "No lineage changes detected.").otherwise(F.concat(F.lit("**"), F.col("n").cast("string"), F.lit(" change(s) detected.**"))).alias("line"))
    return _lines([_one(diff, "# Lineage diff", ""), total, ranked])


def _ends(maps: DataFrame, side: str) -> tuple[Column, Column]:
    """Schema and table of a side; without a table, the component's name split at its first dot."""
    name = text(f"{side}_component_name") if f"{side}_component_name" in maps.columns else F.lit("")
    parts = F.split(name, r"\.", 2)
    none = text(f"{side}_table") == ""
    two = F.size(parts) == 2
    return F.when(none & (name != ""), F.when(two, parts[0]).otherwise(text(f"{side}_schema"))).otherwise(text(f"{side}_schema")), F.when(none, F.when(two, F.try_element_at(parts, F.lit(2))).otherwise(name)).otherwise(text(f"{side}_table"))


def _full(maps: DataFrame, step: str) -> DataFrame:
    get = lambda c: text(c) if c in maps.columns else F.lit("")
    own: dict[str, Column] = {"Step": F.col(step), "Package": get("package_id"), "Task": get("task_id"), "Procedure": get("procedure_name"), "SourceExpression": get("source_expression"), "OperationType": get("operation_type"), "FilterConditions": get("filter_conditions"), "JoinCondition": get("join_details")}
    for s in ("source", "target"):
        schema, table = _ends(maps, s)
        own |= {f"{s.capitalize()}{k}": v for k, v in (("Server", get(f"{s}_server")), ("Database", get(f"{s}_database")), ("Schema", schema), ("Table", table), ("Column", get(f"{s}_column")))}
    own["Operation"], own["Expression"] = own["OperationType"], own["SourceExpression"]
    differ = (own["SourceColumn"] != "") & (own["TargetColumn"] != "") & (own["SourceColumn"] != "*") & (own["TargetColumn"] != "*") & (F.lower(own["SourceColumn"]) != F.lower(own["TargetColumn"]))
    own["Rename"] = F.when(differ, F.concat(own["SourceColumn"], F.lit(" -> "), own["TargetColumn"])).otherwise("")
    return maps.select(*[c.alias(n) for n, c in own.items()])


def _csv(rows: DataFrame, columns: list[str]) -> DataFrame:
    return _lines([_one(rows, ",".join(columns)), rows.select(F.col("Step").cast("int").alias("rank"), F.concat_ws(",", *[csv_text(F.col(c)) for c in columns]).alias("line"))])


def lineage_export(maps: DataFrame) -> DataFrame:
    """The full lineage as CSV lines of 18 columns by step."""
    return _csv(_full(L.mapping_steps(maps), "step_number"), LINEAGE_COLUMNS)


def trace_export(maps: DataFrame, edges: DataFrame) -> DataFrame:
    """The maps of a trace as CSV lines of 19 columns by step, which is the rank and one."""
    steps = edges.select("source_node", F.col("source_column").alias("source_key"), "target_node", F.col("target_column").alias("target_key"), (F.col("step_rank") + 1).alias("step_number")).distinct()
    return _csv(_full(L.keyed(maps).join(steps, ["source_node", "source_key", "target_node", "target_key"]), "step_number"), TRACE_COLUMNS)


def summary(maps: DataFrame, packages: DataFrame | None = None, tasks: DataFrame | None = None, components: DataFrame | None = None, flows: DataFrame | None = None, executions: DataFrame | None = None) -> DataFrame:
    """(tile, n) of the collections of a graph: those given, else what the maps name of them."""
    own = {"packages": packages, "tasks": tasks, "components": components, "dataFlowEdges": flows, "executionEdges": executions}
    named = {"packages": "package_id", "tasks": "task_id"}
    size = lambda name, rows: maps.agg(F.count_distinct(named[name]).alias("n")) if rows is None and name in named else maps.limit(0).agg(F.count("*").alias("n")) if rows is None else rows.agg(F.count("*").alias("n"))
    sizes = {name: size(name, rows) for name, rows in own.items()} | {"columnMappings": maps.agg(F.count("*").alias("n"))}
    one = None
    for name, rows in sizes.items():
        part = rows.select(F.lit(name).alias("tile"), "n")
        one = part if one is None else one.union(part)
    total = lambda name, *of: one.where(F.col("tile").isin(*of)).agg(F.sum("n").alias("n")).select(F.lit(name).alias("tile"), "n")
    return one.union(total("totalNodes", "packages", "tasks", "components")).union(total("totalEdges", "dataFlowEdges", "executionEdges"))


def graph_json(collections: dict[str, DataFrame]) -> DataFrame:
    """A graph as one JSON document: a list under the name of each collection, one item a line."""
    parts: list[DataFrame] = []
    for n, (name, rows) in enumerate(collections.items()):
        parts.append(_one(rows, ("{" if n == 0 else ",") + f'"{name}": ['))
        item = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("item"))
        first = item.agg(F.min("item").alias("item"))  # the first line is the one without a comma before it
        parts.append(first.where("item is not null").select(F.col("item").alias("line")))
        again = L.Window.partitionBy("item").orderBy(F.lit(1))
        parts.append(item.join(F.broadcast(first.withColumn("least", F.lit(True))), "item", "left").withColumn("n", F.when(F.col("least"), F.row_number().over(again)).otherwise(0)).where("n <> 1").select(F.concat(F.lit(","), F.col("item")).alias("line")))
        parts.append(_one(rows, "]"))
    parts.append(_one(next(iter(collections.values())), "}"))
    return _lines(parts)


def workspace(artifacts: dict[str, str], path: str, originals: list[str] | None = None) -> list[str]:
    """A ZIP archive of generated texts, redacted, and of the original package files; gives its names in order."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name in sorted(artifacts):
            out.writestr(name, etl.redact_text(artifacts[name]))
        for own in sorted(originals or []):
            out.write(own, f"packages/{Path(own).name}")
        return out.namelist()


def column_diagram(maps: DataFrame) -> DataFrame:
    """(src, dst, src_rank, src_place): distinct column edges for a diagram, with ranks and places in a rank.

    An asset is a component, where there is one, before a table. Ranks are longest paths, loops
    condensed; places number the assets of a rank by name.
    """
    asset = lambda s: F.when(text(f"{s}_component_name") != "", text(f"{s}_component_name")).otherwise(label(text(f"{s}_schema"), text(f"{s}_table"))) if f"{s}_component_name" in maps.columns else label(text(f"{s}_schema"), text(f"{s}_table"))
    edges = maps.select(asset("source").alias("src_asset"), label(asset("source"), text("source_column")).alias("src"), asset("target").alias("dst_asset"), label(asset("target"), text("target_column")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()
    ranked = L.ranks(edges.select(F.col("src_asset").alias("src"), F.col("dst_asset").alias("dst")))
    placed = ranked.withColumn("src_place", F.row_number().over(L.Window.partitionBy("rank").orderBy("id")))
    return edges.join(placed.select(F.col("id").alias("src_asset"), F.col("rank").alias("src_rank"), "src_place"), "src_asset").select("src", "dst", "src_rank", "src_place")
