"""Package projects as tables: packages, tasks, components, column maps and edges from their XML.

Package files are read as binary files and parsed on the executors with
mapInPandas; every row of the result has a kind, so one scan gives all tables.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import tsql

SCHEMA = "kind string, package_id string, id string, name string, type string, parent_id string, fields map<string,string>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attribute(element: ET.Element, name: str) -> str:
    """An attribute by its local name."""
    return next((v for k, v in element.attrib.items() if _local(k) == name), "")


def children(element: ET.Element, *path: str) -> list[ET.Element]:
    """Descendants along a path of local names."""
    found = [element]
    for name in path:
        found = [c for e in found for c in e if _local(c.tag) == name]
    return found


def every(element: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in element.iter() if _local(e.tag) == name]


def qualify(prefix: str, own: str) -> str:
    """An id that is unique in its project: ids in braces are, others get their owner's."""
    return own if not own or own.startswith("{") else f"{prefix}::{own}"


def _property(component: ET.Element, *names: str) -> str:
    for p in children(component, "properties", "property"):
        if attribute(p, "name") in names and (p.text or "").strip():
            return (p.text or "").strip()
    return ""


def component_kind(class_id: str) -> str:
    """The usual type of a component's class id."""
    low = class_id.lower()
    for word, usual in (("derivedcolumn", "Derived Column"), ("oledbsource", "OLE DB Source"), ("oledbdestination", "OLE DB Destination"), ("lookup", "Lookup"), ("aggregate", "Aggregate"), ("conditionalsplit", "Conditional Split"), ("unionall", "Union All"), ("sort", "Sort"), ("scriptcomponent", "Script Component"), ("managedcomponenthost", "ADO.NET Component")):
        if word in low:
            return usual
    return class_id or "Component"


def table_name(text: str) -> tuple[str, str]:
    """(schema, table) of a table reference; a query has neither."""
    if not text or re.match(r"\s*(select|with|exec)\b", text, re.I):
        return "", ""
    parts = [p.strip('[]" ') for p in re.findall(r"\[[^\]]*\]|\"[^\"]*\"|[^.\[\]\"]+", text.strip())]
    parts = [p for p in parts if p]
    return (parts[-2] if len(parts) > 1 else "dbo", parts[-1]) if parts else ("", "")


def parse_package(content: bytes, path: str) -> list[tuple]:
    """Rows of SCHEMA of one package file. A file that isn't XML gives one warning."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        return [("warning", "", path, Path(path).stem, "unreadable", "", {"message": str(e)})]
    pid = attribute(root, "DTSID") or attribute(root, "refId") or Path(path).stem
    name = attribute(root, "ObjectName") or Path(path).stem
    rows: list[tuple] = [("package", pid, pid, name, "package", "", {"path": path})]
    variables: dict[str, str] = {}
    for v in every(root, "Variable"):
        value = next((c.text or "" for c in v if _local(c.tag) == "VariableValue"), "")
        full = f"{attribute(v, 'Namespace') or 'User'}::{attribute(v, 'ObjectName')}"
        variables[full] = value
        rows.append(("variable", pid, full, attribute(v, "ObjectName"), "variable", pid, {"value": value}))
    for c in children(root, "ConnectionManagers", "ConnectionManager"):
        inner = every(c, "ConnectionManager")[-1]
        rows.append(("connection", pid, attribute(c, "DTSID") or attribute(c, "refId"), attribute(c, "ObjectName"), attribute(c, "CreationName"), pid, {"connection_string": attribute(inner, "ConnectionString")}))
    tasks(root, pid, pid, variables, rows)
    return rows


def tasks(owner: ET.Element, parent: str, pid: str, variables: dict[str, str], rows: list[tuple]) -> None:
    """Tasks, containers with their content, event handlers and precedence constraints."""
    for e in children(owner, "Executables", "Executable"):
        ref = attribute(e, "refId") or attribute(e, "ObjectName")
        tid = qualify(pid, attribute(e, "DTSID") or ref)
        kind = attribute(e, "ExecutableType") or attribute(e, "CreationName")
        inside = bool(children(e, "Executables", "Executable"))
        rows.append(("container" if inside else "task", pid, tid, attribute(e, "ObjectName"), kind, parent, {"ref_id": qualify(pid, ref), "description": attribute(e, "Description")}))
        for data in every(e, "SqlTaskData") if not inside else []:
            sql_task(data, tid, pid, variables, rows)
        for flow in every(e, "pipeline") if not inside else []:
            data_flow(flow, tid, pid, rows)
        for child in every(e, "ExecutePackageTask") if not inside else []:
            called = next((x.text or "" for x in every(child, "PackageName")), "")
            if called:
                rows.append(("execution_edge", pid, tid, called, "Invokes", tid, {"to": called}))
        tasks(e, tid, pid, variables, rows)
        for handler in children(e, "EventHandlers", "EventHandler"):
            tasks(handler, tid, pid, variables, rows)
    for handler in children(owner, "EventHandlers", "EventHandler") if owner is not None and parent == pid else []:
        tasks(handler, pid, pid, variables, rows)
    for c in children(owner, "PrecedenceConstraints", "PrecedenceConstraint"):
        value = {"": "Success", "0": "Success", "1": "Failure", "2": "Completion"}.get(attribute(c, "Value"), attribute(c, "Value"))
        rows.append(("execution_edge", pid, qualify(pid, attribute(c, "From")), attribute(c, "ObjectName"), value, parent, {"to": qualify(pid, attribute(c, "To")), "expression": attribute(c, "Expression")}))


def _map(pid: str, task: str, source: dict[str, str], target: dict[str, str], operation: str, **more: str) -> tuple:
    fields = {"task_id": task, **{f"source_{k}": v for k, v in source.items()}, **{f"target_{k}": v for k, v in target.items()}, **more}
    return ("map", pid, "", "", operation, task, fields)


def sql_task(data: ET.Element, tid: str, pid: str, variables: dict[str, str], rows: list[tuple]) -> None:
    """The statement of an Execute SQL task: its bindings and the columns that it moves."""
    sql = attribute(data, "SqlStatementSource")
    if attribute(data, "SqlStmtSourceType") == "Variable":
        sql = variables.get(sql, sql)
    bound = [f"{attribute(b, 'ParameterName')} <- {attribute(b, 'DtsVariableName')} ({attribute(b, 'ParameterDirection') or 'Input'})" for b in every(data, "ParameterBinding")]
    bound += [f"Result[{attribute(b, 'ResultName')}] -> {attribute(b, 'DtsVariableName')}" for b in every(data, "ResultBinding")]
    cid = f"{tid}::sql"
    rows.append(("component", pid, cid, "SQL", "Execute SQL", tid, {"sql": sql, "connection": attribute(data, "Connection"), "bindings": "; ".join(bound)}))
    for r in tsql.parse(sql):
        side = lambda s: {k: r[f"{s}_{k}"] for k in ("server", "database", "schema", "table", "column")}  # noqa: B023, E731
        rows.append(_map(pid, tid, side("source"), side("target"), r["operation_type"], source_expression=r["source_expression"], join_details=r["join_details"], filter_conditions=r["filter_conditions"], procedure_name=r["procedure_name"]))


def data_flow(flow: ET.Element, tid: str, pid: str, rows: list[tuple]) -> None:
    """Components, paths and column maps of a data flow. Both ends of a map have qualified ids."""
    owner: dict[str, tuple[str, str]] = {}  # lineage id: component, column
    ends: dict[str, str] = {}  # output or input: component
    names: dict[str, tuple[str, str, str]] = {}
    for c in every(flow, "component"):
        cid = qualify(tid, attribute(c, "refId") or attribute(c, "name"))
        sql = _property(c, "SqlCommand", "OpenRowset", "TableOrViewName")
        names[cid] = (attribute(c, "name"), *table_name(sql))
        connection = next((attribute(x, "connectionManagerRefId") or attribute(x, "connectionManagerID") for x in every(c, "connection")), "")
        rows.append(("component", pid, cid, attribute(c, "name"), component_kind(attribute(c, "componentClassID")), tid, {"sql": sql, "connection": connection, "class_id": attribute(c, "componentClassID")}))
        for o in every(c, "output"):
            ends[attribute(o, "refId")] = cid
            for col in every(o, "outputColumn"):
                owner[attribute(col, "lineageId") or attribute(col, "refId")] = (cid, attribute(col, "name"))
        for i in every(c, "input"):
            ends[attribute(i, "refId")] = cid
    for c in every(flow, "component"):
        cid = qualify(tid, attribute(c, "refId") or attribute(c, "name"))
        kind = component_kind(attribute(c, "componentClassID"))
        end = lambda i, column: {"component_id": i, "component_name": names[i][0], "schema": names[i][1], "table": names[i][2], "column": column} if i in names else {"component_id": i, "column": column}
        for col in every(c, "inputColumn"):
            source, column = owner.get(attribute(col, "lineageId"), ("", attribute(col, "cachedName")))
            external = re.search(r"\[([^\[\]]+)\]$", attribute(col, "externalMetadataColumnId"))
            joined = _property(col, "JoinToReferenceColumn")
            operation = f"LOOKUP_JOIN:{column}={joined}" if joined else kind
            rows.append(_map(pid, tid, end(source, column), end(cid, external[1] if external else attribute(col, "cachedName") or column), operation))
        for col in every(c, "outputColumn"):
            expression = _property(col, "FriendlyExpression", "Expression")
            for used in dict.fromkeys(re.findall(r"\[([^\]@]+)\]", expression)):
                rows.append(_map(pid, tid, end(cid, used), end(cid, attribute(col, "name")), "DERIVED_COLUMN", source_expression=expression))
    for p in every(flow, "path"):
        a, b = ends.get(attribute(p, "startId"), ""), ends.get(attribute(p, "endId"), "")
        rows.append(("data_flow_edge", pid, a, attribute(p, "name"), "path", tid, {"to": b, "ref_id": attribute(p, "refId")}))


def read_packages(spark: SparkSession, folder: str, pattern: str = "*.dtsx") -> DataFrame:
    """All rows of the packages of a folder, with the files' hashes. No files give no rows."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content, digest in frame[["path", "content", "digest"]].itertuples(index=False):
                for row in parse_package(bytes(content), path):
                    out.append((*row[:6], row[6] | ({"file_hash": digest} if row[0] == "package" else {})))
            yield pd.DataFrame(out, columns=["kind", "package_id", "id", "name", "type", "parent_id", "fields"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content", F.sha2("content", 256).alias("digest")).mapInPandas(parse, SCHEMA)


MAP_FIELDS = [f"{s}_{p}" for s in ("source", "target") for p in ("component_id", "component_name", "server", "database", "schema", "table", "column")]


def column_maps(rows: DataFrame) -> DataFrame:
    """The column maps among the rows of packages, empty texts for what isn't known."""
    value = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")).alias(n)
    return rows.where("kind = 'map'").select("package_id", value("task_id"), *[value(f) for f in MAP_FIELDS], F.col("type").alias("operation_type"), *[value(f) for f in ("source_expression", "procedure_name", "join_details", "filter_conditions")])


def project_packages(path: str) -> list[str]:
    """The package names of a project file: of its manifest, else the older form, else the folder's files."""
    file = Path(path)
    if file.is_dir():
        found = sorted(file.glob("*.dtproj"))
        if len(found) != 1:
            raise ValueError(f"{path} holds {len(found)} project files")
        file = found[0]
    if file.suffix.lower() != ".dtproj":
        raise ValueError(f"{path} is no project file")
    root = ET.fromstring(file.read_bytes())
    names = [attribute(p, "Name") for p in every(root, "Package") if attribute(p, "Name")]
    names = names or [n.text or "" for p in every(root, "DtsPackage") for n in p if _local(n.tag) == "Name"]
    names = names or sorted(p.name for p in file.parent.glob("*.dtsx"))
    return [n for n in dict.fromkeys(names) if (file.parent / n).exists()]


def start_packages(names: list[str], start: str) -> list[str]:
    """The packages to begin with: all for 'all' or '*', else the one named, with or without suffix.

    A name may come with a path; where no package has the whole text, its last part counts.
    """
    if start.lower() in ("all", "*"):
        return names
    wanted = start.lower().removesuffix(".dtsx")
    bare = re.split(r"[/\\]", wanted)[-1]
    found = [n for n in names if n.lower().removesuffix(".dtsx") == wanted] or [n for n in names if re.split(r"[/\\]", n.lower().removesuffix(".dtsx"))[-1] == bare]
    if not found:
        raise ValueError(f"no package {start}")
    return found


def reachable(rows: DataFrame, start: list[str]) -> tuple[list[str], list[str]]:
    """Packages reached from start through Execute Package tasks, and those called again (warnings).

    The packages of one project are few and are walked on the driver.
    """
    calls = rows.where("kind = 'execution_edge' and type = 'Invokes'").join(rows.where("kind = 'package'").select("package_id", F.col("name").alias("caller")), "package_id").select("caller", F.col("fields.to").alias("called")).distinct().collect()
    after: dict[str, list[str]] = {}
    for r in calls:
        after.setdefault(r["caller"].lower(), []).append(r["called"].lower().removesuffix(".dtsx"))
    done, again, queue = [], [], [s.lower().removesuffix(".dtsx") for s in start]
    while queue:
        here = queue.pop(0)
        if here in done:
            again.append(here)
            continue
        done.append(here)
        queue += after.get(here, [])
    return done, again


def project_parameters(path: str) -> dict[str, str]:
    """The parameters of a project's *.params files as Project::Name and their values."""
    out: dict[str, str] = {}
    folder = Path(path) if Path(path).is_dir() else Path(path).parent
    for file in sorted(folder.glob("*.params")):
        for p in every(ET.fromstring(file.read_bytes()), "Parameter"):
            value = next((x.text or "" for x in every(p, "Property") if attribute(x, "Name") == "Value"), "")
            out.setdefault(f"Project::{attribute(p, 'Name')}", value)
    return out
