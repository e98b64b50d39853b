"""Data flows and schedules as text: SQL models, scripts, DAGs and pipeline JSON.

The text follows the same components that Flow compiles, so what is emitted is what runs here. No
credentials are ever written; settings come from the environment of whoever runs the text.
"""

from __future__ import annotations

import json
import re
from typing import Any

from weftline.plans.dataflow import FlowError


def identifier(name: str) -> str:
    """name as an identifier: letters, digits and underscores, not a digit first."""
    made = re.sub(r"\W+", "_", name).strip("_").lower() or "unnamed"
    return f"_{made}" if made[0].isdigit() else made


def sql_expression(source: str) -> str:
    """An expression of the data flow as SQL, for the forms that read alike in both."""
    text = re.sub(r'"((?:[^"\\]|\\.)*)"', lambda m: "'" + m[1].replace("'", "''") + "'", source)
    text = re.sub(r"\[([^\]]+)\]", r"\1", text)
    for old, new in (("&&", " AND "), ("||", " OR "), ("==", "="), ("!=", "<>")):
        text = text.replace(old, new)
    text = re.sub(r"!\s*ISNULL\(([^()]*)\)", r"\1 IS NOT NULL", text)
    text = re.sub(r"ISNULL\(([^()]*)\)", r"\1 IS NULL", text)
    found = re.fullmatch(r"\s*([^?]+)\?([^?:]+):([^?]+)", text)
    return re.sub(r"\s+", " ", f"CASE WHEN {found[1].strip()} THEN {found[2].strip()} ELSE {found[3].strip()} END" if found else text).strip()


def _ordered(components: list[dict[str, Any]], paths: list[tuple]) -> list[tuple[dict[str, Any], list[tuple[str, str]]]]:
    into: dict[str, list[tuple[str, str]]] = {c["id"]: [] for c in components}
    for p in paths:
        into[p[1]].append((p[0], p[2] if len(p) > 2 else ""))
    done: list[str] = []
    own = {c["id"]: c for c in components}
    while len(done) < len(components):
        ready = [i for i in own if i not in done and all(a in done for a, _ in into[i])]
        if not ready:
            raise FlowError("the paths run in a circle")
        done += ready
    return [(own[i], into[i]) for i in done]


def sql_model(components: list[dict[str, Any]], paths: list[tuple], source: str = "{{{{ source('{0}') }}}}") -> str:
    """One SELECT with a common table expression for each component; the last one is the model."""
    parts, last = [], ""
    splits: dict[str, dict[str, Any]] = {}
    for c, inputs in _ordered(components, paths):
        name, kind = identifier(c["id"]), c["type"].lower()
        from_ = identifier(inputs[0][0]) if inputs else ""
        where = ""
        if inputs and inputs[0][0] in splits:
            where = f" WHERE _route = '{inputs[0][1]}'"
        if "source" in kind:
            body = c["query"] if c.get("query") else f"SELECT * FROM {source.format(c['table'])}"
        elif "lookup" in kind:
            if not c.get("keys"):
                raise FlowError("a lookup needs a join key")
            keys, columns = list(c["keys"].values()), c.get("columns", {})
            on = " AND ".join(f"i.{a} = r.{b}" for a, b in c["keys"].items())
            reference = f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join([*columns.values()] or keys)}) AS _n FROM {source.format(c['reference'])}"
            body = f"SELECT i.*{''.join(f', r.{b} AS {a}' for a, b in columns.items())} FROM {from_} i LEFT JOIN ({reference}) r ON {on} AND r._n = 1{where}"
        elif "derived" in kind:
            body = f"SELECT *{''.join(f', {sql_expression(e)} AS {n}' for n, e in c['columns'].items())} FROM {from_}{where}"
        elif "split" in kind:
            splits[c["id"]] = c
            body = f"SELECT *, CASE {' '.join(f"WHEN {sql_expression(e)} THEN '{n}'" for n, e in c['cases'].items())} ELSE '{c.get('default', 'default')}' END AS _route FROM {from_}{where}"
        elif "union" in kind:
            body = " UNION ALL ".join(f"SELECT * FROM {identifier(a)}" + (f" WHERE _route = '{n}'" if a in splits else "") for a, n in inputs)
        elif "aggregate" in kind:
            made = [f"{'COUNT(DISTINCT ' if 'distinct' in op else {'average': 'AVG', 'minimum': 'MIN', 'maximum': 'MAX'}.get(op, op.upper()) + '('}{col}) AS {n}" for n, (op, col) in c["aggregates"].items()]
            body = f"SELECT {', '.join([*c.get('group', []), *made])} FROM {from_}{where}" + (f" GROUP BY {', '.join(c['group'])}" if c.get("group") else "")
        elif "destination" in kind and c.get("mappings"):
            body = f"SELECT {', '.join((sql_expression(m['expression']) if m.get('expression') else m['source']) + ' AS ' + m['target'] for m in c['mappings'])} FROM {from_}{where}"
        else:
            body = f"SELECT * FROM {from_}{where}"
        parts.append(f"{name} AS (\n  {body}\n)")
        last = name
    return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM {last}\n"


def consolidated_sql(components: list[dict[str, Any]], paths: list[tuple], target: str) -> str:
    """The model as one INSERT ... SELECT."""
    return f"INSERT INTO {target}\n{sql_model(components, paths, '{0}')}"


def spark_script(components: list[dict[str, Any]], paths: list[tuple], target: str) -> str:
    """A script that runs the flow here and writes its last component."""
    last = _ordered(components, paths)[-1][0]["id"]
    return (
        "from pyspark.sql import SparkSession\n\nfrom weftline.plans.dataflow import Flow\n\n"
        "spark = SparkSession.builder.getOrCreate()\n"
        f"components = {components!r}\npaths = {paths!r}\n"
        f"Flow(components, paths, spark.table).output({last!r}).write.mode('append').saveAsTable({target!r})\n"
    )


def airflow_dag(name: str, tasks: dict[str, str], edges: list[tuple[str, str]]) -> str:
    """A DAG with an operator for each task (id to type) and its edges; without edges, in order."""
    kinds = {"Execute SQL Task": "SQLExecuteQueryOperator", "Data Flow Task": "SparkSubmitOperator", "Execute Package Task": "TriggerDagRunOperator", "Script Task": "PythonOperator", "Send Mail Task": "EmailOperator"}
    ids = {t: identifier(t) for t in tasks}
    pairs = [(a, b) for a, b in edges if a in ids and b in ids] or list(zip(tasks, list(tasks)[1:], strict=False))
    lines = ["from airflow import DAG", f"with DAG({identifier(name)!r}, schedule=None, catchup=False) as dag:"]
    lines += [f"    {ids[t]} = {kinds.get(k, 'EmptyOperator')}(task_id={ids[t]!r})" for t, k in tasks.items()]
    return "\n".join(lines + [f"    {ids[a]} >> {ids[b]}" for a, b in pairs]) + "\n"


def pipeline_json(name: str, tasks: dict[str, str], edges: list[tuple[str, str]]) -> str:
    """A pipeline of activities with their dependencies."""
    kinds = {"Execute SQL Task": "SqlServerStoredProcedure", "Data Flow Task": "ExecuteDataFlow", "Execute Package Task": "ExecutePipeline"}
    made = [{"name": t, "type": kinds.get(k, "Custom"), "dependsOn": [{"activity": a, "dependencyConditions": ["Succeeded"]} for a, b in edges if b == t]} for t, k in tasks.items()]
    return json.dumps({"name": name, "properties": {"activities": made}}, indent=2)


def job_json(name: str, tasks: dict[str, str], edges: list[tuple[str, str]]) -> str:
    """A folder of jobs that wait for one another's events."""
    done = lambda t: f"{identifier(t)}-OK"
    jobs = {identifier(t): {"Type": "Job:Command", "Command": f"run {identifier(t)}", **({"WaitForEvents": {"Events": [{"Event": done(a)} for a, b in edges if b == t]}} if any(b == t for _, b in edges) else {}), "EventsToAdd": {"Events": [{"Event": done(t)}]}} for t in tasks}
    return json.dumps({identifier(name): {"Type": "Folder", **jobs}}, indent=2)


# What no artifact may hold, by rule.
RULES = {
    "RULE-01": (r"ON\s+1\s*=\s*[01]\b", "a join without a key"),
    "RULE-02": (r"\(DT_\w+", "a cast that wasn't translated"),
    "RULE-03": (r"@\[\w+::", "a variable without a value"),
    "RULE-04": (r"(?i)(password|pwd)\s*=\s*[^;'\"\s*]+", "a credential"),
    "RULE-05": (r"(?m)^\s*WITH\s*$|AS\s*\(\s*\)", "an empty model"),
    "RULE-06": (r"\bDUMMY\b", "a dynamic name without a value"),
}


def quality_gate(artifacts: dict[str, str]) -> list[tuple[str, str, str]]:
    """(file, rule, what is wrong) of all artifacts; an empty list passes."""
    return [(file, rule, what) for file, text in artifacts.items() for rule, (pattern, what) in RULES.items() if re.search(pattern, text)]
