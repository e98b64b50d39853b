"""Scanned packages as data flows that run here, and as artifacts for other platforms.

A package's rows, as read_packages gives them, are turned to the components and paths of Flow: sources
and destinations by their tables, derived columns by their expressions, lookups by the operations of
their maps, or, where those name no key, by the columns of both sides. One data flow is one task of a
package, so its rows are few and are planned on the driver.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.etl import redact_text
from weftline.plans import emit
from weftline.plans.dataflow import Flow, Tables
from weftline.sources.connections import server_and_database

#: Components and maps that one data flow may have.
MOST = 100_000
# The targets that a data flow can be converted to.
TARGETS = ["dbt", "spark", "pandas", "sql", "airflow", "adf", "controlm"]


def data_flows(rows: DataFrame) -> list[str]:
    """The ids of the tasks that are data flows, in order."""
    part = (F.col("kind") == "data_flow_edge") | ((F.col("kind") == "component") & F.lower("type").rlike("source|destination"))
    found = rows.where(part).select("parent_id").distinct().orderBy("parent_id").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} data flows; convert them by package")
    return [r["parent_id"] for r in found]


def flow_parts(rows: DataFrame, task: str) -> tuple[list[dict[str, Any]], list[tuple]]:
    """(components, paths) of one data flow of a package."""
    own = rows.where((F.col("parent_id") == task) & F.col("kind").isin("component", "map", "data_flow_edge")).limit(MOST + 1).collect()
    if len(own) > MOST:
        raise ValueError(f"{task} has more than {MOST} rows")
    maps = [r["fields"] | {"operation": r["type"]} for r in own if r["kind"] == "map"]
    components = []
    for r in sorted((r for r in own if r["kind"] == "component"), key=lambda r: r["id"]):
        kind, sql = r["type"].lower(), (r["fields"] or {}).get("sql", "")
        c: dict[str, Any] = {"id": r["id"], "type": r["type"], "name": r["name"]}
        into = [m for m in maps if m.get("target_component_id") == r["id"]]
        query = sql.strip().lower().startswith(("select", "with"))
        if "source" in kind:
            c |= {"query": sql} if query else {"table": _plain(sql)}
        elif "lookup" in kind:
            c["reference"] = _plain(sql.split(" from ")[-1].split(" FROM ")[-1]) if query else _plain(sql)
            c["operations"] = [m["operation"] for m in into]
            c["columns"] = {m["source_column"]: m["source_column"] for m in maps if m.get("source_component_id") == r["id"] and m.get("source_column")}
        elif "derived" in kind:
            c["columns"] = {m["target_column"]: m["source_expression"] for m in into if m["operation"] == "DERIVED_COLUMN"}
        elif "destination" in kind:
            c["table"] = _plain(sql)
            c["mappings"] = [{"target": m["target_column"], "source": m["source_column"], "operation": m["operation"]} for m in into]
        components.append(c)
    known = {c["id"] for c in components}
    paths = [(r["id"], r["fields"]["to"]) for r in own if r["kind"] == "data_flow_edge" and r["id"] in known and r["fields"].get("to") in known]
    return components, sorted(paths)


def _plain(reference: str) -> str:
    return reference.replace("[", "").replace("]", "").replace('"', "").strip()


def package_flow(rows: DataFrame, task: str, tables: Tables, variables: dict[str, object] | None = None) -> Flow:
    """A scanned data flow, ready to run over tables."""
    components, paths = flow_parts(rows, task)
    return Flow(components, paths, tables, variables)


def pandas_script(components: list[dict[str, Any]], paths: list[tuple], target: str) -> str:
    """A script that reads the model's rows in chunks from the database and appends them to the target."""
    model = emit.consolidated_sql(components, paths, target).split("\n", 1)[1]
    return (
        "import os\n\nimport pandas as pd\nimport sqlalchemy\n\n"
        'engine = sqlalchemy.create_engine(os.environ["SOURCE_URL"])\n'
        'into = sqlalchemy.create_engine(os.environ["TARGET_URL"])\n'
        f"MODEL = {model!r}\n"
        "for chunk in pd.read_sql(sqlalchemy.text(MODEL), engine, chunksize=50_000):\n"
        f"    chunk.to_sql({target.split('.')[-1]!r}, into, schema={(target.split('.')[-2] if '.' in target else None)!r}, if_exists='append', index=False)\n"
    )


def env_pair(connections: dict[str, str]) -> tuple[str, str]:
    """(.env, .env.example) for connections by name: servers and databases, never credentials."""
    real, example = [], []
    for name in sorted(connections):
        server, database = server_and_database(connections[name])
        key = emit.identifier(name).upper()
        real += [f"{key}_SERVER={server}", f"{key}_DATABASE={database}", f"{key}_USER=", f"{key}_PASSWORD="]
        example += [f"{key}_SERVER=server", f"{key}_DATABASE=database", f"{key}_USER=user", f"{key}_PASSWORD=change-me"]
    return "\n".join(real) + "\n", "\n".join(example) + "\n"


def schema_yaml(name: str, components: list[dict[str, Any]]) -> str:
    """The columns of a model's destinations, with tests for those that end in id or key."""
    lines = ["version: 2", "models:", f"  - name: {emit.identifier(name)}", "    columns:"]
    for c in components:
        for m in c.get("mappings", []):
            lines.append(f"      - name: {m['target']}")
            if m["target"].lower().endswith(("id", "key")):
                lines.append("        tests: [not_null]")
    return "\n".join(lines) + "\n"


def convert(rows: DataFrame, target: str, strict: bool = True) -> dict[str, str]:
    """Artifacts (file to text) of all data flows of scanned packages for one of TARGETS.

    Texts are redacted and pass the quality gate; what fails it is left out under strict and reported
    in VALIDATION.md in both cases. A flow that can't be planned is reported there too. airflow, adf
    and controlm make one artifact of all tasks and their order.
    """
    if target not in TARGETS:
        raise ValueError(f"unknown target {target}; known are {', '.join(TARGETS)}")
    made: dict[str, str] = {}
    wrong: list[str] = []
    if target in ("airflow", "adf", "controlm"):
        tasks = {r["id"]: r["type"] for r in rows.where("kind = 'task'").orderBy("id").limit(MOST).collect()}
        edges = [(r["id"], r["fields"]["to"]) for r in rows.where("kind = 'execution_edge'").orderBy("id").limit(MOST).collect()]
        how = {"airflow": ("dag.py", emit.airflow_dag), "adf": ("pipeline.json", emit.pipeline_json), "controlm": ("jobs.json", emit.job_json)}[target]
        made[how[0]] = how[1]("packages", tasks, edges)
    else:
        for task in data_flows(rows):
            components, paths = flow_parts(rows, task)
            name = emit.identifier(task)
            into = next((c["table"] for c in components if "destination" in c["type"].lower()), name)
            try:
                for c in components:
                    pairs = [o.split(":", 1)[1].split("=") for o in c.get("operations", []) if o.startswith("LOOKUP_JOIN:")]
                    if pairs:
                        c["keys"] = {a: b for a, b in pairs}
                if target == "dbt":
                    made |= {f"models/{name}.sql": emit.sql_model(components, paths), f"models/{name}.yml": schema_yaml(task, components)}
                elif target == "spark":
                    made[f"{name}.py"] = emit.spark_script(components, paths, into)
                elif target == "pandas":
                    made[f"{name}.py"] = pandas_script(components, paths, into)
                else:
                    made[f"{name}.sql"] = emit.consolidated_sql(components, paths, into)
            except ValueError as e:
                wrong.append(f"- {task}: {e}")
        if target == "dbt":
            made["dbt_project.yml"] = "name: packages\nversion: '1.0'\nprofile: packages\nmodel-paths: [models]\n"
    made = {file: redact_text(text) for file, text in made.items()}
    faults = emit.quality_gate(made)
    wrong += [f"- {file}: {rule} {what}" for file, rule, what in faults]
    if strict:
        made = {file: text for file, text in made.items() if file not in {f for f, _, _ in faults}}
    made["VALIDATION.md"] = "# Validation\n\n" + ("\n".join(wrong) if wrong else "All artifacts pass.") + "\n"
    return made


def mapping_json(flow: Flow) -> str:
    """The components of a flow with the input that supplies them, as JSON, for checks by eye."""
    return json.dumps({name: [a for a, _ in into] for name, into in flow.into.items()}, indent=2)
