"""A whole scan: packages to enriched column maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import enrich
from weftline.operators.lineage import linked_servers
from weftline.sources.packages import column_maps, read_packages


def component_rows(rows: DataFrame) -> DataFrame:
    """(package_id, task_id, component_id, name, type, sql, connection) of scanned components."""
    field = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")).alias(n)
    return rows.where("kind = 'component'").select("package_id", F.col("parent_id").alias("task_id"), F.col("id").alias("component_id"), "name", "type", field("sql"), field("connection"))


def enriched_maps(rows: DataFrame, definitions: DataFrame | None = None, servers: DataFrame | None = None) -> DataFrame:
    """The column maps of scanned packages with all that enrichment adds, in its order.

    Maps of procedures that the scan brought are replaced by those of definitions (schema_name, name,
    body), references of lookups are added, both ends get the server and database of their
    components' connections, and servers (name, data_source) replaces linked servers. Without
    definitions the scan's own maps stay.
    """
    maps, components = column_maps(rows), component_rows(rows)
    blank = [F.lit("").alias(c) for c in maps.columns]
    fit = lambda more: more.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in more.columns else b for c, b in zip(maps.columns, blank, strict=True)])
    if definitions is not None:
        made = enrich.procedure_maps(components, definitions).withColumn("target_component_id", F.col("component_id"))
        maps = enrich.purge(maps).unionByName(fit(made))
    maps = maps.unionByName(fit(enrich.lookup_references(components)))
    strings = F.coalesce(F.try_element_at("fields", F.lit("connection_string")), F.lit(""))
    known = rows.where("kind = 'connection'").select(F.explode(F.array_distinct(F.array("id", "name"))).alias("id"), strings.alias("connection_string")).where("id <> ''").dropDuplicates(["id"])
    maps = enrich.stamp(maps, components, known)
    return maps if servers is None else linked_servers(maps, servers)


def scan(spark: SparkSession, folder: str, definitions: DataFrame | None = None, servers: DataFrame | None = None) -> DataFrame:
    """The enriched column maps of all packages of a folder. No files give no maps."""
    return enriched_maps(read_packages(spark, folder), definitions, servers)
