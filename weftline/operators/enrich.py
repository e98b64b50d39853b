"""Enrichment of scanned maps: procedure bodies, lookup references, names from connections.

What a live server would answer comes from tables: procedure_definitions (schema_name, name, body),
linked servers and column owners. All joins are equalities on lower-case keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import text
from weftline.sources import tsql
from weftline.sources.connections import database_column, server_column

CALL = r"(?is)^\s*exec(?:ute)?\s+(?:@\w+\s*=\s*)?(?:\[?(\w+)\]?\.)?\[?(\w+)\]?"
NAME = r"(?s)^\s*(?:\[?(\w+)\]?\.)?\[?(\w+)\]?\s*$"


def purge(maps: DataFrame) -> DataFrame:
    """maps without those of procedures, which enrichment makes anew."""
    return maps.where(~text("operation_type").startswith("SQL_PROC_"))


def procedure_maps(components: DataFrame, definitions: DataFrame) -> DataFrame:
    """Lineage records of the procedures that components call, operations as SQL_PROC_...

    components has package_id, task_id, component_id and sql; a text that isn't a call counts as a
    procedure's name only where definitions has it, so table names aren't taken for procedures.
    """
    called = F.when(F.col("sql").rlike(CALL), F.lower(F.regexp_extract("sql", CALL, 2))).when(F.col("sql").rlike(NAME), F.lower(F.regexp_extract("sql", NAME, 2)))
    schema = F.when(F.col("sql").rlike(CALL), F.lower(F.regexp_extract("sql", CALL, 1))).otherwise(F.lower(F.regexp_extract("sql", NAME, 1)))
    calls = components.select("package_id", "task_id", "component_id", called.alias("proc"), F.when(schema == "", "dbo").otherwise(schema).alias("proc_schema")).where("proc is not null")
    known = definitions.select(F.lower("schema_name").alias("proc_schema"), F.lower("name").alias("proc"), "body")
    rows = calls.join(known, ["proc_schema", "proc"]).select("package_id", "task_id", "component_id", "body")
    return tsql.lineage_records(rows, ["package_id", "task_id", "component_id"], "body").withColumn("operation_type", F.concat(F.lit("SQL_PROC_"), F.col("operation_type")))


def lookup_references(components: DataFrame) -> DataFrame:
    """Maps of the tables that Lookup components read: '*' of a table, else the columns of their query."""
    rows = components.where(F.lower("type").contains("lookup") & (text("sql") != "")).select("package_id", "task_id", "component_id", "name", "sql")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for package, task, component, name, sql in frame.itertuples(index=False):
                if sql.lstrip().lower().startswith(("select", "with", "(")):
                    out += [(package, task, component, name, r["source_schema"], r["source_table"], r["source_column"], r["target_column"] or r["source_column"]) for r in tsql.parse(sql) if r["operation_type"] == "SELECT" and r["source_table"]]
                else:
                    parts = [p.strip('[]" ') for p in sql.split(".")]
                    out.append((package, task, component, name, parts[-2] if len(parts) > 1 else "dbo", parts[-1], "*", "*"))
            yield pd.DataFrame(out, columns=["package_id", "task_id", "target_component_id", "target_component_name", "source_schema", "source_table", "source_column", "target_column"])

    made = rows.mapInPandas(read, "package_id string, task_id string, target_component_id string, target_component_name string, source_schema string, source_table string, source_column string, target_column string")
    return made.withColumn("operation_type", F.lit("LOOKUP_REF"))


def stamp(maps: DataFrame, components: DataFrame, connections: DataFrame) -> DataFrame:
    """maps with server and database of both ends, by the connections of their components.

    components has component_id and connection, connections has id and connection_string. Ends that
    know their server or database keep it; all maps of data flows are stamped, whatever their kind.
    """
    own = components.join(connections.select(F.lower("id").alias("c"), "connection_string"), F.lower("connection") == F.col("c"), "left").select(
        F.lower("component_id").alias("cid"), server_column(F.col("connection_string")).alias("server"), database_column(F.col("connection_string")).alias("database")
    ).dropDuplicates(["cid"])
    out = maps
    for side in ("source", "target"):
        named = own.withColumnsRenamed({"cid": f"_{side}", "server": f"_{side}_server", "database": f"_{side}_database"})
        out = out.join(named, F.lower(text(f"{side}_component_id")) == F.col(f"_{side}"), "left")
        out = out.withColumns({f"{side}_{p}": F.when(text(f"{side}_{p}") != "", F.col(f"{side}_{p}")).otherwise(F.coalesce(f"_{side}_{p}", F.lit(""))) for p in ("server", "database")})
    return out.select(*maps.columns)


def layered_variables(layers: list[DataFrame]) -> DataFrame:
    """(name, value): of several layers (name, value) the last that has a name counts."""
    out = None
    for n, layer in enumerate(layers):
        rows = layer.select(F.lower("name").alias("name"), "value", F.lit(n).alias("layer"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("name").agg(F.max_by("value", "layer").alias("value"))
