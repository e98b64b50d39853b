"""Lineage as text: Cypher, Mermaid, OpenLineage, CSV, JSON, Markdown, HTML and contract YAML.

Exports are DataFrames of lines with their order, so graphs of any size are written in parallel; only
write_lines() to one local file streams them through the driver, a partition at a time. Secrets are
redacted in all of them.
"""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import etl
from weftline.operators.lineage import label, text


def _lines(parts: list[DataFrame]) -> DataFrame:
    """(section, rank, line) of parts in order, redacted; rank keeps the order of fixed lines."""
    out = None
    for n, part in enumerate(parts):
        rank = F.col("rank") if "rank" in part.columns else F.lit(0)
        rows = part.select(F.lit(n).alias("section"), rank.alias("rank"), etl.redact(F.col("line")).alias("line"))
        out = rows if out is None else out.union(rows)
    return out


def _one(like: DataFrame, *lines: str) -> DataFrame:
    return like.sparkSession.createDataFrame(list(enumerate(lines)), "rank int, line string")


def cypher_text(column: Column) -> Column:
    """A column as the inside of a Cypher string."""
    plain = F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("\r"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))


def csv_text(column: Column) -> Column:
    """A column as a quoted CSV field."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(column.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def names(maps: DataFrame, side: str, column: bool = True) -> Column:
    """The label of a map's side; without a table, its component's name."""
    table = label(text(f"{side}_schema"), text(f"{side}_table"))
    if f"{side}_component_name" in maps.columns:
        table = F.when(text(f"{side}_table") == "", text(f"{side}_component_name")).otherwise(table)
    return label(table, text(f"{side}_column")) if column else table


def cypher(maps: DataFrame, components: DataFrame | None = None, executions: DataFrame | None = None, flows: DataFrame | None = None) -> DataFrame:
    """Constraints, packages, tasks and mapped columns as Cypher statements.

    components (component_id, task_id, name, type) adds nodes that belong to their tasks, executions
    (src, dst, value) the order of tasks, flows (src, dst) the paths between components.
    """
    packages = maps.select("package_id").distinct().select(F.format_string("MERGE (:Package {id: '%s'});", cypher_text(F.col("package_id"))).alias("line"))
    tasks = maps.select("package_id", "task_id").distinct().select(F.format_string("MERGE (t:Task {id: '%s'}) WITH t MATCH (p:Package {id: '%s'}) MERGE (t)-[:BELONGS_TO]->(p);", cypher_text(F.col("task_id")), cypher_text(F.col("package_id"))).alias("line"))
    edges = maps.select(names(maps, "source").alias("s"), names(maps, "target").alias("t"), "operation_type").distinct()
    mapped = edges.select(F.format_string("MERGE (a:Column {name: '%s'}) MERGE (b:Column {name: '%s'}) CREATE (a)-[:MAPS_TO {operation: '%s'}]->(b);", cypher_text(F.col("s")), cypher_text(F.col("t")), cypher_text(F.col("operation_type"))).alias("line"))
    heads = [f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{kind}) REQUIRE n.{key} IS UNIQUE;" for kind, key in (("Package", "id"), ("Task", "id"), ("Column", "name"))]
    parts = [_one(maps, *heads), packages, tasks, mapped]
    arrow = "MATCH (a:{0} {{id: '%s'}}), (b:{0} {{id: '%s'}}) MERGE (a)-[:{1}]->(b);"
    if components is not None:
        made = "MERGE (c:Component {id: '%s', name: '%s', type: '%s'}) WITH c MATCH (t:Task {id: '%s'}) MERGE (c)-[:BELONGS_TO]->(t);"
        parts.append(components.select(F.format_string(made, *[cypher_text(F.col(c)) for c in ("component_id", "name", "type", "task_id")]).alias("line")).distinct())
    if executions is not None:
        precedes = arrow.format("Task", "PRECEDES {{on: '%s'}}").replace("{{", "{").replace("}}", "}")
        parts.append(executions.select(F.format_string(precedes, *[cypher_text(F.col(c)) for c in ("src", "dst", "value")]).alias("line")).distinct())
    if flows is not None:
        parts.append(flows.select(F.format_string(arrow.format("Component", "FLOWS_TO"), *[cypher_text(F.col(c)) for c in ("src", "dst")]).alias("line")).distinct())
    return _lines(parts)


def mermaid(maps: DataFrame) -> DataFrame:
    """The distinct table edges as a Mermaid graph; nodes are named by a hash of their label."""
    edges = maps.select(names(maps, "source", False).alias("s"), names(maps, "target", False).alias("t"), etl.operation_label(F.col("operation_type")).alias("op")).where("s <> '' and t <> '' and s <> t").distinct()
    node = lambda c: F.format_string('n%s["%s"]', F.hex(F.xxhash64(F.lower(c))), F.replace(c, F.lit('"'), F.lit("'")))
    return _lines([_one(maps, "flowchart LR"), edges.select(F.format_string("  %s -->|%s| %s", node(F.col("s")), F.col("op"), node(F.col("t"))).alias("line"))])


def openlineage(maps: DataFrame, namespace: str = "weftline", producer: str = "weftline") -> DataFrame:
    """One COMPLETE event a task as JSON, with the inputs of each field of its outputs; '*' is left out."""
    named = maps.where("target_column <> '*'")
    field = named.groupBy("package_id", "task_id", names(maps, "target", False).alias("output"), F.col("target_column").alias("field")).agg(
        F.array_sort(F.collect_set(F.struct(F.lit(namespace).alias("namespace"), names(maps, "source", False).alias("name"), F.col("source_column").alias("field")))).alias("inputFields")
    )
    output = field.groupBy("package_id", "task_id", "output").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("inputFields"))))).alias("fields"), F.flatten(F.collect_list("inputFields")).alias("used"))
    task = output.groupBy("package_id", "task_id").agg(
        F.array_distinct(F.flatten(F.collect_list(F.transform("used", lambda u: F.struct(u["namespace"].alias("namespace"), u["name"].alias("name")))))).alias("inputs"),
        F.array_sort(F.collect_list(F.struct(F.lit(namespace).alias("namespace"), F.col("output").alias("name"), F.to_json("fields").alias("columnLineage")))).alias("outputs"),
    )
    event = F.struct(F.lit("COMPLETE").alias("eventType"), F.struct(F.lit(namespace).alias("namespace"), F.concat_ws(".", "package_id", "task_id").alias("name")).alias("job"), "inputs", "outputs", F.lit(producer).alias("producer"))
    return _lines([task.select(F.to_json(event).alias("line"))])


def lineage_csv(report: DataFrame) -> DataFrame:
    """A table as CSV lines with every field quoted."""
    head = ",".join(f'"{c}"' for c in report.columns)
    return _lines([_one(report, head), report.select(F.concat_ws(",", *[csv_text(F.col(c)) for c in report.columns]).alias("line"))])


def json_lines(rows: DataFrame) -> DataFrame:
    """A table as JSON lines."""
    return _lines([rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))])


def markdown(title: str, sections: dict[str, DataFrame]) -> DataFrame:
    """Tables as Markdown, each under its heading."""
    parts = []
    for heading, rows in sections.items():
        head = [f"# {title}", ""] if not parts else [""]
        parts.append(_one(rows, *head, f"## {heading}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)))
        cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
        parts.append(rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |")).alias("line")))
    return _lines(parts)


def html_report(title: str, sections: dict[str, DataFrame]) -> DataFrame:
    """Tables as an HTML page with an anchor for each section."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    parts = []
    for heading, rows in sections.items():
        head = [f"<html><head><title>{html.escape(title)}</title></head><body>"] if not parts else ["</table>"]
        anchor = heading.lower().replace(" ", "-")
        parts.append(_one(rows, *head, f'<h2 id="{anchor}">{html.escape(heading)}</h2><table><tr>' + "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns) + "</tr>"))
        parts.append(rows.select(F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[safe(c) for c in rows.columns]), F.lit("</td></tr>")).alias("line")))
    parts.append(_one(next(iter(sections.values())), "</table></body></html>"))
    return _lines(parts)


def contract_yaml(contract: DataFrame) -> DataFrame:
    """A contract (table_name, column_name) as YAML, a block for each table."""
    tables = contract.groupBy("table_name").agg(F.array_sort(F.collect_set("column_name")).alias("c"))
    line = F.concat(F.lit('  - name: "'), F.col("table_name"), F.lit('"\n    columns:\n'), F.array_join(F.transform("c", lambda x: F.concat(F.lit('      - name: "'), x, F.lit('"\n        required: true'))), "\n"))
    return _lines([_one(contract, "version: 1", "tables:"), tables.select(line.alias("line"))])


def write_lines(lines: DataFrame, path: str) -> int:
    """Write lines in order to one local file; gives their number."""
    n = 0
    with Path(path).open("w", encoding="utf-8") as out:
        for row in lines.orderBy("section", "rank", "line").toLocalIterator():
            out.write(row["line"] + "\n")
            n += 1
    return n


def yaml_lines(name: str, rows: DataFrame) -> DataFrame:
    """A table as a YAML list under name; every value is a quoted text."""
    quoted = lambda c: F.to_json(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")))
    value = lambda c: F.regexp_extract(quoted(c), r"(?s)^\{\"v\":(.*)\}$", 1)
    item = F.concat(F.lit("  - "), F.concat_ws("\n    ", *[F.concat(F.lit(f"{c}: "), value(c)) for c in rows.columns]))
    return _lines([_one(rows, f"{name}:"), rows.select(item.alias("line"))])


def workbook(sheets: dict[str, DataFrame], folder: str) -> list[str]:
    """The sheets of a workbook as one CSV file each, written to a local folder; gives their paths."""
    made = []
    for name, rows in sheets.items():
        path = str(Path(folder) / f"{name}.csv")
        write_lines(lineage_csv(rows), path)
        made.append(path)
    return made
