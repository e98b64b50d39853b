"""Data flows as Spark plans: a component graph is compiled to DataFrames and run as one query.

Components are dictionaries with id, type and their settings; paths are (from, to) or
(from, to, output) for components with several outputs. Catalyst sees the whole flow, so filters and
columns reach the scans whatever component they come from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.expressions import Compiler
from weftline.operators.resolve import lookup_keys

Tables = Callable[[str], DataFrame]
# Aggregate operations of the data flow.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "average": F.avg, "avg": F.avg, "minimum": F.min, "min": F.min, "maximum": F.max, "max": F.max, "count": F.count, "count distinct": F.count_distinct, "count_distinct": F.count_distinct,
}


class FlowError(ValueError):
    """A flow that can't be compiled."""


def lookup(rows: DataFrame, reference: DataFrame, keys: dict[str, str], columns: dict[str, str], no_match: str = "null") -> DataFrame:
    """rows with columns (new name to reference column) of the one match in reference.

    keys pairs input with reference columns; without keys the flow isn't compiled. Of several
    matches the least by the columns taken counts, so no row is multiplied. Null keys match nothing.
    no_match is 'null', 'drop' (the no-match output is left out) or 'only' (the no-match output).
    """
    if not keys:
        raise FlowError("a lookup needs a join key")
    taken = F.struct(*[F.col(c).alias(n) for n, c in columns.items()]) if columns else F.struct(F.lit(1).alias("_"))
    one = reference.where(" and ".join(f"`{c}` is not null" for c in keys.values())).groupBy(*[F.col(c).alias(f"_key_{k}") for k, c in enumerate(keys.values())]).agg(F.min(taken).alias("_found"))
    on = [F.col(f"`{c}`") == F.col(f"_key_{k}") for k, c in enumerate(keys)]
    kept = [c for c in rows.columns if c not in columns]
    if no_match == "only":
        return rows.join(one, on, "left_anti")
    joined = rows.join(one, on, "inner" if no_match == "drop" else "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_found.{n}").alias(n) for n in columns])


def derived(rows: DataFrame, columns: dict[str, str], variables: dict[str, object] | None = None, parity: bool = False) -> DataFrame:
    """rows with columns computed from expressions; all see the columns as they came in."""
    compiler = Compiler(rows.schema, variables, parity)
    return rows.withColumns({n: compiler.compile(e) for n, e in columns.items()})


def conditional_split(rows: DataFrame, cases: dict[str, str], default: str = "default", variables: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """One DataFrame for each output; a row goes to the first case that holds, else to default."""
    compiler = Compiler(rows.schema, variables)
    route = None
    for name, test in cases.items():
        column = compiler.compile(test)
        route = F.when(column, name) if route is None else route.when(column, name)
    chosen = F.lit(default) if route is None else route.otherwise(default)
    return {name: rows.where(chosen == name) for name in [*cases, default]}


def aggregate(rows: DataFrame, group: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Groups with their aggregates, (operation, column) by new name; '*' counts rows."""
    made = [(F.count("*") if column == "*" else AGGREGATES[operation.lower()](F.col(column))).alias(name) for name, (operation, column) in aggregates.items()]
    return rows.groupBy(*group).agg(*made)


def sort(rows: DataFrame, by: list[tuple[str, bool]], remove_duplicates: bool = False) -> DataFrame:
    """rows in order (column, ascending); with remove_duplicates one row for each sort key.

    Of rows with one key the least by all columns stays.
    """
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in by]
    if remove_duplicates:
        rank = Window.partitionBy(*[c for c, _ in by]).orderBy(*rows.columns)
        rows = rows.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")
    return rows.orderBy(*order)


def union_all(inputs: Iterable[DataFrame]) -> DataFrame:
    """All rows of all inputs, by column name; missing columns are null."""
    out = None
    for rows in inputs:
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise FlowError("a union needs an input")
    return out


def map_columns(rows: DataFrame, mappings: list[dict[str, str]]) -> DataFrame:
    """The columns of a destination: of several mappings to one target the best is taken.

    A mapping has target, source and perhaps expression and operation; one with an expression goes
    before a derived column, that before a lookup's, and the first of equals counts.
    """
    rank = lambda m: 0 if m.get("expression") else 1 if m.get("operation") == "DERIVED_COLUMN" else 2 if m.get("operation", "").startswith("LOOKUP") else 3
    best: dict[str, dict[str, str]] = {}
    for m in mappings:
        key = m["target"].lower()
        if key not in best or rank(m) < rank(best[key]):
            best[key] = m
    compiler = Compiler(rows.schema)
    return rows.select(*[(compiler.compile(m["expression"]) if m.get("expression") else compiler.column(m["source"]).column).alias(m["target"]) for m in best.values()])


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], delete_unmatched: bool = False) -> DataFrame:
    """target after MERGE: matched rows take the source's columns, unmatched ones are inserted.

    Keys are unique in source. With delete_unmatched rows that the source lacks are deleted.
    """
    new = source.select(*keys, F.struct(*columns).alias("_new"))
    old = target.select(*keys, F.struct(*columns).alias("_old"))
    both = old.join(new, keys, "right" if delete_unmatched else "full")
    return both.select(*keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns])


def delete_join(target: DataFrame, other: DataFrame, keys: dict[str, str]) -> DataFrame:
    """target after DELETE ... FROM target JOIN other: rows with a match are gone."""
    return target.join(other.select(*[F.col(c).alias(f"_d{k}") for k, c in enumerate(keys.values())]), [F.col(c) == F.col(f"_d{k}") for k, c in enumerate(keys)], "left_anti")


def update_from(target: DataFrame, other: DataFrame, keys: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """target after UPDATE ... SET column = other.column FROM other; the least of several matches."""
    matched = lookup(target, other, keys, {f"_new_{c}": o for c, o in columns.items()} | {"_hit": next(iter(keys.values()))})
    return matched.select(*[F.when(F.col("_hit").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def expectations(rows: DataFrame, statuses: dict[str, list[str]] | None = None) -> DataFrame:
    """(rule, column_name, failed, passed) of data-quality rules, in one pass over rows.

    Rules: at least one row; columns that end in 'id' or 'key' aren't null; 'id' and 'pk_' columns
    are unique; columns in statuses only hold the values given.
    """
    statuses = statuses or {}
    checks = [("row_count", "*", F.when(F.count("*") >= 1, 0).otherwise(1))]
    for c in rows.columns:
        low = c.lower()
        if low.endswith(("id", "key")):
            checks.append(("not_null", c, F.count_if(F.col(c).isNull())))
        if low == "id" or low.startswith("pk_"):
            checks.append(("unique", c, F.count(c) - F.count_distinct(c)))
        if c in statuses:
            checks.append(("in_set", c, F.count_if(~F.col(c).isin(statuses[c]))))
    one = rows.agg(*[v.cast("long").alias(f"v{k}") for k, (_, _, v) in enumerate(checks)])
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column_name"), F.col(f"v{k}").alias("failed")) for k, (r, c, _) in enumerate(checks)])
    return one.select(F.inline(listed)).withColumn("passed", F.col("failed") == 0)


class Flow:
    """A data flow of components and paths, compiled on demand."""

    def __init__(self, components: list[dict[str, Any]], paths: list[tuple], tables: Tables, variables: dict[str, object] | None = None, parity: bool = False) -> None:
        self.components = {c["id"]: c for c in components}
        self.into: dict[str, list[tuple[str, str]]] = {c["id"]: [] for c in components}
        for path in paths:
            self.into[path[1]].append((path[0], path[2] if len(path) > 2 else ""))
        self.tables, self.variables, self.parity = tables, variables, parity
        self.made: dict[str, DataFrame | dict[str, DataFrame]] = {}
        self.warnings: list[str] = []

    def _keys(self, c: dict[str, Any], rows: DataFrame, reference: DataFrame) -> dict[str, str]:
        """The join keys of a lookup that names none, by its maps' operations and both sides' columns."""
        earlier = {n: own["id"] for own in self.components.values() if "lookup" in own["type"].lower() and own["id"] != c["id"] for n in own.get("columns", {})}
        return lookup_keys(rows.columns, reference.columns, c.get("operations"), earlier)[0]

    def output(self, component: str, name: str = "", trail: tuple[str, ...] = ()) -> DataFrame:
        """The rows that leave a component, by the name of its output where it has several."""
        if component in trail:
            raise FlowError(f"the paths run in a circle at {component}")
        if component not in self.made:
            self.made[component] = self._compile(self.components[component], (*trail, component))
        made = self.made[component]
        if isinstance(made, dict):
            if name not in made:
                raise FlowError(f"{component} has no output {name!r}")
            return made[name]
        return made

    def _compile(self, c: dict[str, Any], trail: tuple[str, ...]) -> DataFrame | dict[str, DataFrame]:
        inputs = [self.output(a, n, trail) for a, n in self.into[c["id"]]]
        kind = c["type"].lower()
        if "source" in kind:
            return SparkSession.active().sql(c["query"]) if c.get("query") else self.tables(c["table"])
        if not inputs:
            raise FlowError(f"{c['id']} has no input")
        rows = inputs[0]
        if "lookup" in kind:
            reference = self.tables(c["reference"])
            keys = c.get("keys") or self._keys(c, rows, reference)
            if keys:
                return lookup(rows, reference, keys, c.get("columns", {}), c.get("no_match", "null"))
            self.warnings.append(f"lookup {c['id']}: no join key found, nothing matches")
            kept = [n for n in rows.columns if n not in c.get("columns", {})]
            empty = rows.select(*kept, *[F.lit(None).cast(reference.schema[r].dataType).alias(n) for n, r in c.get("columns", {}).items()])
            return empty.where("false") if c.get("no_match") == "drop" else empty
        if "derived" in kind:
            return derived(rows, c["columns"], self.variables, self.parity)
        if "conversion" in kind:
            return rows.withColumns({n: F.col(s).try_cast(t) for n, (s, t) in c["casts"].items()})
        if "split" in kind:
            return conditional_split(rows, c["cases"], c.get("default", "default"), self.variables)
        if "union" in kind or kind == "merge":
            return union_all(inputs)
        if "merge join" in kind:
            return inputs[0].join(inputs[1], c["keys"], c.get("how", "inner"))
        if "aggregate" in kind:
            return aggregate(rows, c.get("group", []), c["aggregates"])
        if "sort" in kind:
            return sort(rows, c["by"], c.get("remove_duplicates", False))
        if "script" in kind:
            return rows.mapInPandas(c["function"], c["schema"])
        if "multicast" in kind or "row count" in kind:
            return rows
        if "destination" in kind:
            return map_columns(rows, c["mappings"]) if c.get("mappings") else rows
        raise FlowError(f"unknown component type {c['type']}")

    def run(self, write: Callable[[str, DataFrame], None]) -> list[str]:
        """Write the rows of every destination; gives their tables."""
        done = []
        for c in self.components.values():
            if "destination" in c["type"].lower():
                write(c["table"], self.output(c["id"]))
                done.append(c["table"])
        return done
