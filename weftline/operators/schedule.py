"""Execution order, estimated durations and the critical path of tasks."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import graphs
from weftline.operators.lineage import text
from weftline.session import checkpointed

# Estimated seconds of a task by its type, and what each component of a data flow adds.
DATA_FLOW, EXECUTE_SQL, PROCEDURE, EXECUTE_PACKAGE, SCRIPT, OTHER = 45, 20, 50, 90, 35, 10
COMPONENTS = [("sort", 60), ("aggregate", 45), ("lookup", 25), ("source", 30), ("destination", 20), ("script", 40)]
# The buffer of a service level, the total from which it is at risk, levels of a task.
BUFFER, AT_RISK, HIGH, MEDIUM = 1.25, 600, 300, 120


def usual_type(column: Column) -> Column:
    """Task types in one spelling: packages store class names, older exports the display names."""
    low = F.lower(F.coalesce(column, F.lit("")))
    return (
        F.when(low.contains("pipeline") | low.contains("data flow"), "Data Flow Task")
        .when(low.contains("executesqltask") | low.contains("execute sql"), "Execute SQL Task")
        .when(low.contains("executepackage") | low.contains("execute package"), "Execute Package Task")
        .when(low.contains("script"), "Script Task")
        .when(low.contains("sendmail") | low.contains("send mail"), "Send Mail Task")
        .otherwise(column)
    )


def component_seconds(column: Column) -> Column:
    """What a component adds to its data flow, by the first word of COMPONENTS in its type."""
    out = None
    for word, seconds in COMPONENTS:
        hit = F.lower(F.coalesce(column, F.lit(""))).contains(word)
        out = F.when(hit, seconds) if out is None else out.when(hit, seconds)
    return out.otherwise(0)


def durations(tasks: DataFrame, components: DataFrame) -> DataFrame:
    """(task_id, package_id, seconds, level, reason) of each task.

    tasks has task_id, package_id, type, description; components has task_id, package_id, type. A data
    flow counts all components of its package, as the estimate is one of the package's load.
    """
    load = components.groupBy("package_id").agg(
        F.sum(component_seconds(F.col("type"))).alias("load"),
        *[F.count_if(F.lower("type").contains(w)).alias(w) for w in ("sort", "aggregate", "lookup")],
    )
    kind = usual_type(F.col("type"))
    seconds = (
        F.when(kind == "Data Flow Task", DATA_FLOW + F.coalesce("load", F.lit(0)))
        .when(kind == "Execute SQL Task", EXECUTE_SQL + F.when(F.upper(text("description")).contains("PROCEDURE"), PROCEDURE).otherwise(0))
        .when(kind == "Execute Package Task", EXECUTE_PACKAGE).when(kind == "Script Task", SCRIPT).otherwise(OTHER)
    )
    reason = (
        F.when(F.col("sort") > 0, "PERF-001: In-memory blocking Sort transformation").when(F.col("aggregate") > 0, "PERF-001: In-memory Aggregate transformation")
        .when(F.col("lookup") >= 2, "Multiple Lookup CTE joins against large reference tables").when(kind == "Execute Package Task", "Child Package Orchestration barrier")
        .otherwise("High Data Flow component throughput processing")
    )
    level = F.when(seconds >= HIGH, "High").when(seconds >= MEDIUM, "Medium").otherwise("Low")
    return tasks.join(load, "package_id", "left").select("task_id", "package_id", seconds.cast("double").alias("seconds"), level.alias("level"), reason.alias("reason"))


def finish_times(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, seconds, finish, before): the longest weighted path that ends with each task.

    edges has src and dst; those to unknown tasks and from a task to itself are skipped. Tasks of a
    loop start together, after all tasks that lead to the loop. before is the task waited for last.
    """
    found = graphs.longest_paths(edges, tasks.select(F.col("task_id").alias("id"), F.col("seconds").alias("weight")))
    return found.select(F.col("id").alias("task_id"), (F.col("finish") - F.col("start")).alias("seconds"), "finish", "before")


def critical_path(tasks: DataFrame, edges: DataFrame) -> dict[str, object]:
    """The tasks of the longest path, its seconds, the recommended service level and whether it is at risk.

    Every task knows the one that it waited for last, so the path is what the latest task reaches over
    these links: one search, whatever the length of the path. Of equal finishes the least task counts.
    """
    state = checkpointed(finish_times(tasks, edges))
    last = state.orderBy(F.desc("finish"), "task_id").first()
    if last is None:
        return {"path": [], "seconds": 0.0, "service_level": 0, "at_risk": False}
    back = graphs.reachable(state.select(F.col("task_id").alias("src"), F.col("before").alias("dst")), state.where(F.col("task_id") == last["task_id"]).select(F.col("task_id").alias("id")))
    path = [r["task_id"] for r in state.join(back.withColumnRenamed("id", "task_id"), "task_id").orderBy("finish", "task_id").collect()]
    seconds = last["finish"]
    return {"path": path, "seconds": seconds, "service_level": int(-(-seconds * BUFFER // 1)), "at_risk": seconds > AT_RISK}


def execution_sequence(names: dict[str, str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Positions of the tasks of one package: first-in-first-out topological order, ties by name.

    Tasks on loops follow by name. A package's tasks are few, so this runs on the driver.
    """
    after, waits = defaultdict(list), dict.fromkeys(names, 0)
    for a, b in dict.fromkeys(edges):
        if a in names and b in names and a != b:
            after[a].append(b)
            waits[b] += 1
    by_name = sorted(names, key=lambda n: (names[n].lower(), n))
    queue, order = deque(n for n in by_name if not waits[n]), []
    while queue:
        here = queue.popleft()
        order.append(here)
        freed = []
        for n in after[here]:
            waits[n] -= 1
            if not waits[n]:
                freed.append(n)
        queue.extend(sorted(freed, key=lambda n: (names[n].lower(), n)))
    order += [n for n in by_name if n not in set(order)]
    return {n: k + 1 for k, n in enumerate(order)}
