"""Saved graphs and configuration files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The collections of a saved graph, and the maps of a configuration file.
COLLECTIONS = ["packages", "tasks", "components", "dataFlowEdges", "executionEdges", "columnMappings"]
SETTINGS = ["variables", "linkedServers", "sqlVariables", "connectionManagers"]


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The collections of a graph saved as JSON, by name; those that are missing or empty are left out.

    A file without packages and column mappings is no graph and an error, as is one that isn't JSON.
    Names of collections ignore letter case. The file is one document, so it is read by one task.
    """
    whole = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    known = {c.lower(): c for c in COLLECTIONS}
    found = {}
    for field in whole.schema.fields:
        name = known.get(field.name.lower())
        if name and field.dataType.typeName() == "array" and field.dataType.elementType.typeName() == "struct":
            found[name] = whole.selectExpr(f"inline(`{field.name}`)")
    if not {"packages", "columnMappings"} & set(found):
        raise ValueError(f"{path} holds neither packages nor column mappings")
    return found


def load_settings(path: str | None) -> dict[str, dict[str, str]]:
    """The maps of a JSON configuration file, each empty where it is missing; values become texts."""
    given = json.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else {}
    low = {k.lower(): v for k, v in given.items() if isinstance(v, dict)} if isinstance(given, dict) else {}
    return {name: {str(k): str(v) for k, v in low.get(name.lower(), {}).items() if v is not None} for name in SETTINGS}


def pairs(typed: str | None) -> dict[str, str]:
    """Settings typed as 'name=value; ...'; parts without a name are left out, the last of equal names counts."""
    out = {}
    for part in (typed or "").split(";"):
        name, sign, value = part.partition("=")
        if sign and name.strip():
            out[name.strip()] = value.strip()
    return out


def connection_lines(typed: str | None) -> dict[str, str]:
    """Connections typed one a line as 'name=connection string'; what follows the first '=' is the string."""
    out = {}
    for line in (typed or "").splitlines():
        name, sign, value = line.partition("=")
        if sign and name.strip() and value.strip():
            out[name.strip()] = value.strip()
    return out
