"""Queries over the lineage derived from lineitem, and over column_map, with the SQL they match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import etl
from weftline.operators import lineage as L
from weftline.operators import narrative as N
from weftline.operators import questions as Q
from weftline.operators import resolve as R
from weftline.operators import schedule as S
from weftline.session import checkpointed, table
from weftline.sinks import exports
from weftline.sources import tsql

Query = Callable[[SparkSession, str], DataFrame]
SEED_TABLE, SEED_COLUMN, LATE_TABLE = "L0.t3", "c1", "L6.t50"


def _on(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(L.derived_maps(spark, sf_dir))


def _tasks(maps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks, components and edges between them, derived from the maps."""
    own = maps.select("package_id", "task_id").distinct().withColumn("k", F.element_at(F.split("task_id", "_"), -1).cast("int"))
    kind = F.when(F.col("k") % 3 == 0, "Data Flow Task").when(F.col("k") % 3 == 1, "Execute SQL Task").otherwise("Execute Package Task")
    tasks = own.select("task_id", "package_id", kind.alias("type"), F.when(F.col("k") == 1, "CALLS A PROCEDURE").otherwise("").alias("description"))
    part = F.element_at(F.array(*[F.lit(x) for x in ("Lookup", "OLE DB Source", "Sort", "OLE DB Destination", "Aggregate", "Derived Column")]), F.col("k") + 1)
    components = own.select("package_id", "task_id", part.alias("type"))
    edges = own.alias("a").join(own.alias("b"), (F.col("a.package_id") == F.col("b.package_id")) & (F.col("b.k") == F.col("a.k") + 1)).select(F.col("a.task_id").alias("src"), F.col("b.task_id").alias("dst"))
    return tasks, components, edges


def _durations(maps: DataFrame) -> DataFrame:
    tasks, components, _ = _tasks(maps)
    return S.durations(tasks, components)


def _finish(maps: DataFrame) -> DataFrame:
    tasks, components, edges = _tasks(maps)
    return S.finish_times(S.durations(tasks, components), edges).drop("before")


def _critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of the longest path in order."""
    tasks, components, edges = _tasks(L.derived_maps(spark, sf_dir))
    path = S.critical_path(S.durations(tasks, components), edges)["path"]
    return spark.createDataFrame(list(enumerate(path, 1)), "place long, task_id string")


def _diff(maps: DataFrame) -> DataFrame:
    return L.graph_diff(maps.where("package_id <> 'pkg_3'"), maps.where("package_id <> 'pkg_5'"))


def _bridges(maps: DataFrame) -> DataFrame:
    pairs = checkpointed(L.column_pairs(maps))
    return L.bridges(L.column_edges(pairs), L.registry(pairs))


def _spec(spark: SparkSession) -> DataFrame:
    rows = [("L1.t8", "c0", True), ("L1.t8", "c9", True), ("L2.t17", "c1", False), ("L9.t99", "c0", True), ("L3.t25", "c0", True), ("L3.t25", "c8", False)]
    return spark.createDataFrame(rows, "table_name string, column_name string, required boolean")


def _mermaid(maps: DataFrame) -> DataFrame:
    """The edges of the Mermaid export, with the labels that its nodes have."""
    line = r'^  n[0-9A-F]+\["([^"]*)"\] -->\|([^|]*)\| n[0-9A-F]+\["([^"]*)"\]$'
    return exports.mermaid(maps).where("section = 1").select(*[F.regexp_extract("line", line, k).alias(n) for n, k in (("src", 1), ("op", 2), ("dst", 3))])


def _openlineage(maps: DataFrame) -> DataFrame:
    """The inputs of each field of each output in the events of the OpenLineage export."""
    event = "job struct<name string>, outputs array<struct<name string, columnLineage string>>"
    fields = "map<string, struct<inputFields: array<struct<name: string, field: string>>>>"
    out = exports.openlineage(maps).select(F.from_json("line", event).alias("e")).select(F.col("e.job.name").alias("job"), F.explode("e.outputs").alias("o"))
    each = out.select("job", F.col("o.name").alias("output"), F.explode(F.from_json("o.columnLineage", fields)).alias("field", "f"))
    return each.select(F.element_at(F.split("job", r"\."), -1).alias("task_id"), "output", "field", F.array_join(F.array_sort(F.transform("f.inputFields", lambda x: F.concat_ws(".", x["name"], x["field"]))), ",").alias("input_fields"))


def _renames(maps: DataFrame) -> DataFrame:
    flag = (F.col("source_column") != "") & (F.col("target_column") != "") & (F.col("source_column") != "*") & (F.col("target_column") != "*") & (F.lower("source_column") != F.lower("target_column"))
    return maps.where(flag).groupBy(L.label(F.col("source_schema"), F.col("source_table"), F.col("source_column")).alias("source_label"), L.label(F.col("target_schema"), F.col("target_table"), F.col("target_column")).alias("target_label")).agg(F.count("*").alias("n"))


def _reports(maps: DataFrame) -> DataFrame:
    count = lambda c: F.count_distinct(*c).alias("n")
    parts = {"packages": ["package_id"], "tasks": ["task_id"], "source_tables": ["source_schema", "source_table"], "target_tables": ["target_schema", "target_table"], "operations": ["operation_type"]}
    rows = maps.groupBy(*L.MAP[:6], "target_table", "operation_type").agg(F.count("*").alias("m"))
    out = rows.agg(F.sum("m").alias("n")).select(F.lit("maps").alias("tile"), "n")
    for name, columns in parts.items():
        out = out.union(rows.agg(count(columns)).select(F.lit(name), "n"))
    return out


def _real_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """column_map with the engine's names; null is the empty text."""
    m = table(spark, sf_dir, "column_map")
    return m.withColumnsRenamed({"source_column_name": "source_column", "target_column_name": "target_column"})


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of candidate tables, resolved by the columns that single tables are known to have."""
    maps = _real_maps(spark, sf_dir)
    owners = maps.where("source_table not like '%|%'").select(F.trim("source_table").alias("table_name"), F.trim("source_column").alias("column_name"))
    return L.candidate_resolution(maps, owners)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    servers = spark.createDataFrame([("SRV-KOP03", "staging-a"), ("srv-kop05", "staging-b"), ("SRV-DW01", "warehouse")], "name string, data_source string")
    return L.linked_servers(_real_maps(spark, sf_dir), servers).groupBy("source_server", "target_server").agg(F.count("*").alias("n"))


def _real_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "column_map").groupBy("operation_type").agg(F.count("*").alias("n"))
    return m.select("operation_type", etl.operation_label(F.col("operation_type")).alias("op_label"), "n")


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of documents with a connection string after them, redacted."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", etl.redact(F.concat(F.coalesce("text", F.lit("")), F.lit(" Server=a;Password=p"), F.col("doc_id").cast("string"), F.lit(";token = t;User="), L.text("source"))).alias("redacted"))


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Microsoft.DerivedColumn", "OLEDBSource.2", "Lookup", "{1F-2A}", "TxScript", "", "SortTransform", "Aggregate", "FlatFile")]), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = p.select("p_partkey", kind.alias("raw"), F.concat(F.lit("Part "), F.col("p_size").cast("string")).alias("name"))
    usual = etl.component_type(F.col("raw"), F.col("name"))
    return rows.select("p_partkey", usual.alias("component_type"), etl.component_advice(usual).alias("advice"))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one script for each order: an insert with a join, read by the T-SQL reader."""
    o = table(spark, sf_dir, "orders")
    sql = F.format_string("INSERT INTO dw.Fact_%s (k, v) SELECT o.k, c.v * 2 FROM stg.O%s o JOIN stg.C c ON c.k = o.k WHERE o.id = %s", F.col("o_orderstatus"), (F.col("o_custkey") % 7).cast("string"), F.col("o_orderkey").cast("string"))
    records = tsql.lineage_records(o.select("o_orderkey", sql.alias("sql")), ["o_orderkey"], "sql")
    return records.groupBy("operation_type", "source_table", "source_column", "target_schema", "target_table", "target_column", "source_expression").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    "trace_downstream": _on(lambda m: L.trace(m, SEED_TABLE, SEED_COLUMN, "down")),
    "trace_upstream": _on(lambda m: L.trace(m, LATE_TABLE, "c2", "up")),
    "trace_table_downstream": _on(lambda m: L.trace(m, SEED_TABLE, None, "down").drop("step_rank")),
    "trace_wildcard_bridge": _on(_bridges),
    "search_tables": _on(lambda m: L.search(m, "t1", "table")),
    "search_columns": _on(lambda m: L.search(m, "t2", "column")),
    "mapping_steps": _on(lambda m: L.mapping_steps(m).groupBy("source_schema", "source_table", "step_number").agg(F.count("*").alias("n"))),
    "column_lineage_report": _on(L.column_lineage_report),
    "table_risk_scores": _on(L.risk_scores),
    "table_risk_levels": _on(lambda m: L.risk_levels(L.risk_scores(m))),
    "packages_writing_to_table": _on(lambda m: Q.packages_at(m, "L3.t25", "target")),
    "packages_reading_from_table": _on(lambda m: Q.packages_at(m, "t11", "source")),
    "packages_using_column": _on(lambda m: Q.packages_using(m, "c3")),
    "high_fanout_columns": _on(lambda m: Q.high_fanout(m, 5)),
    "orphan_tables": _on(Q.orphans),
    "package_inventory": _on(Q.package_inventory),
    "table_mappings": _on(lambda m: Q.table_mappings(m, "t9")),
    "column_sources": _on(lambda m: Q.column_ends(m, "t17", "source")),
    "column_targets": _on(lambda m: Q.column_ends(m, "t9", "target")),
    "question_answer": _on(lambda m: Q.answer(m, "load to t12")),
    "rename_edges": _on(_renames),
    "impact_drop_column": _on(lambda m: L.impact(m, "drop_column", "L2.t18", "c1")),
    "impact_rename_column": _on(lambda m: L.impact(m, "rename_column", "t20", "c2", "c2_new")),
    "impact_drop_table": _on(lambda m: L.impact(m, "drop_table", "L4.t33")),
    "impact_change_type": _on(lambda m: L.impact(m, "change_type", "L3.t26", "c0", "bigint")),
    "impact_checklist": _on(lambda m: L.checklist(L.impact(m, "drop_table", "L4.t34"), "drop_table", "L4.t34")),
    "contract_columns": _on(L.contract),
    "contract_violations": lambda spark, sf_dir: L.contract_violations(_spec(spark), L.derived_maps(spark, sf_dir)),
    "lineage_diff": _on(_diff),
    "object_edge_counts": _on(R.object_edges),
    "mermaid_edges": _on(_mermaid),
    "openlineage_inputs": _on(_openlineage),
    "summary_tiles": _on(_reports),
    "drill_down_task": _on(lambda m: N.drill_down(m, task_id="task_3_2")),
    "complete_columns": _on(lambda m: N.complete(m, "C", "l2.t18")),
    "package_effort": _on(lambda m: N.effort(m.select("package_id", "task_id", "target_table").distinct())),
    "narratives": _on(N.task_narratives),
    "task_recommendations": _on(lambda m: N.task_recommendations(_tasks(m)[0])),
    "tsql_lineage_records": _scripts,
    "task_duration_estimates": _on(_durations),
    "critical_path_distances": _on(_finish),
    "critical_path": _critical_path,
    "candidate_table_resolution": _candidates,
    "linked_server_rewrite": _linked,
    "operation_labels": _real_operations,
    "redacted_text": _redacted,
    "component_type_normalization": _types,
}

_M = f"maps AS ({L.MAPS_SQL})"
_E = f"""{_M}, edges AS (SELECT DISTINCT 't:' || lower(source_schema || '.' || source_table) AS sn, lower(source_column) AS sk,
 't:' || lower(target_schema || '.' || target_table) AS tn, lower(target_column) AS tk FROM maps
 WHERE NOT (source_schema || source_table = target_schema || target_table AND source_column = target_column)),
 known AS (SELECT DISTINCT n, k FROM (SELECT sn AS n, sk AS k FROM edges UNION ALL SELECT tn, tk FROM edges))"""
_DOWN = """, crossing AS (SELECT k.n, k.k, e.tn FROM known k JOIN (SELECT DISTINCT sn, tn FROM edges WHERE sk = '*' AND tk = '*') e ON e.sn = k.n
  WHERE k.k <> '*' AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.sn = k.n AND o.sk = k.k)),
 bridge AS (SELECT c.n AS sn, c.k AS sk, c.tn, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.n = c.tn AND k.k = c.k) THEN c.k ELSE '*' END AS tk FROM crossing c)"""
_UP = """, crossing AS (SELECT k.n, k.k, e.sn FROM known k JOIN (SELECT DISTINCT sn, tn FROM edges WHERE sk = '*' AND tk = '*') e ON e.tn = k.n
  WHERE k.k <> '*' AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.tn = k.n AND o.tk = k.k)),
 bridge AS (SELECT c.sn, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.n = c.sn AND k.k = c.k) THEN c.k ELSE '*' END AS sk, c.n AS tn, c.k AS tk FROM crossing c)"""


def _trace(seed: str, down: bool, rank: bool = True) -> str:
    near, far = ("s", "t") if down else ("t", "s")
    return f"""WITH RECURSIVE {_E}{_DOWN if down else _UP}, hops AS (SELECT * FROM edges UNION SELECT * FROM bridge),
 reached(n, k) AS (SELECT n, k FROM known WHERE {seed} UNION SELECT h.{far}n, h.{far}k FROM reached r JOIN hops h ON h.{near}n = r.n AND h.{near}k = r.k),
 used AS (SELECT e.* FROM edges e JOIN reached r ON r.n = e.{near}n AND r.k = e.{near}k
  UNION SELECT b.sn, '*', b.tn, '*' FROM bridge b JOIN reached r ON r.n = b.{near}n AND r.k = b.{near}k),
 pairs AS (SELECT DISTINCT sn || '|' || sk AS s, tn || '|' || tk AS t FROM used),
 depth(n, d) AS (SELECT s, 0 FROM pairs UNION SELECT p.t, d + 1 FROM depth JOIN pairs p ON p.s = depth.n),
 ranks AS (SELECT n, max(d) AS d FROM depth GROUP BY n)
SELECT u.sn AS source_node, u.sk AS source_column, u.tn AS target_node, u.tk AS target_column{", CAST(r.d AS INTEGER) AS step_rank" if rank else ""} FROM used u JOIN ranks r ON r.n = u.sn || '|' || u.sk"""


_STEPS = f"""WITH RECURSIVE {_M}, pairs AS (SELECT DISTINCT source_schema || '.' || source_table AS s, target_schema || '.' || target_table AS t FROM maps),
 depth(n, d) AS (SELECT DISTINCT s, 0 FROM pairs UNION SELECT p.t, d + 1 FROM depth JOIN pairs p ON p.s = depth.n WHERE p.s <> p.t),
 ranks AS (SELECT n, max(d) AS d FROM depth GROUP BY n), stepped AS (SELECT m.*, CAST(r.d + 1 AS INTEGER) AS step_number FROM maps m JOIN ranks r ON r.n = m.source_schema || '.' || m.source_table)
"""
_RISK = f"""WITH RECURSIVE {_M}, named AS (SELECT *, lower(source_schema || '.' || source_table) AS s, lower(target_schema || '.' || target_table) AS t FROM maps),
 pairs AS (SELECT DISTINCT s, t FROM named WHERE s <> t),
 depth(n, d) AS (SELECT s, 0 FROM pairs UNION SELECT p.t, d + 1 FROM depth JOIN pairs p ON p.s = depth.n),
 tables AS (SELECT s AS n FROM named UNION SELECT t FROM named),
 numbers AS (SELECT b.n AS table_name,
  (SELECT count(DISTINCT t) FROM named WHERE s = b.n AND t <> b.n) AS downstream_tables,
  (SELECT count(DISTINCT package_id) FROM named WHERE t = b.n) AS writer_packages,
  (SELECT count(DISTINCT package_id) FROM named WHERE s = b.n) AS reader_packages,
  CAST(coalesce((SELECT max(d) FROM depth WHERE depth.n = b.n), 0) AS BIGINT) AS depth,
  (SELECT count(*) FROM named WHERE s = b.n) + (SELECT count(*) FROM named WHERE t = b.n) AS mapping_count,
  NOT EXISTS (SELECT 1 FROM named WHERE s = b.n) AS is_final_target FROM tables b),
 scored AS (SELECT *, CAST(round_even(downstream_tables / max(downstream_tables) OVER () * 25, 0) AS INTEGER) AS fan_out_score,
  CAST(round_even(depth / max(depth) OVER () * 25, 0) AS INTEGER) AS depth_score,
  CAST(round_even(reader_packages / max(reader_packages) OVER () * 25, 0) AS INTEGER) AS shared_score,
  CAST(round_even(mapping_count / max(mapping_count) OVER () * 25, 0) AS INTEGER) AS mapping_score FROM numbers),
 totals AS (SELECT *, fan_out_score + depth_score + shared_score + mapping_score AS score FROM scored),
 levels AS (SELECT *, CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS level FROM totals)
"""
_LABEL = "source_schema || '.' || source_table || '.' || source_column"
_LABEL2 = "target_schema || '.' || target_table || '.' || target_column"


def _impact(severity: str, where_source: str, where_target: str, column: bool) -> str:
    other = lambda s: f"{s}_table || '.' || {s}_column" if column else "''"
    part = lambda side, o, w: f"SELECT '{severity}' AS severity, 'Column Mapping' AS category, package_id, task_id, '{side}' AS side, {other(o)} AS other, count(*) AS n_maps FROM maps WHERE {w} GROUP BY ALL"
    return f"WITH {_M} {part('source', 'target', where_source)} UNION ALL {part('target', 'source', where_target)}"


_TASKS = f"""{_M}, own AS (SELECT DISTINCT package_id, task_id, CAST(split_part(task_id, '_', 3) AS INTEGER) AS k FROM maps),
 load AS (SELECT package_id, sum([25, 30, 60, 20, 45, 0][k + 1]) AS load, count(*) FILTER (k = 2) AS sorts, count(*) FILTER (k = 4) AS aggs FROM own GROUP BY 1),
 timed AS (SELECT task_id, own.package_id, CAST(CASE WHEN k % 3 = 0 THEN 45 + load WHEN k % 3 = 1 THEN 20 + CASE WHEN k = 1 THEN 50 ELSE 0 END ELSE 90 END AS DOUBLE) AS seconds,
  CASE WHEN sorts > 0 THEN 'PERF-001: In-memory blocking Sort transformation' WHEN aggs > 0 THEN 'PERF-001: In-memory Aggregate transformation'
   WHEN k % 3 = 2 THEN 'Child Package Orchestration barrier' ELSE 'High Data Flow component throughput processing' END AS reason, k
  FROM own JOIN load ON load.package_id = own.package_id)"""
_PACKAGES = "SELECT package_id AS \"primary\", string_agg(DISTINCT task_id, ', ' ORDER BY task_id) AS secondary, '{0}' AS category, count(*) AS n FROM maps WHERE {1} GROUP BY 1"

ORACLE: dict[str, str] = {
    "trace_downstream": _trace("n = 't:l0.t3' AND k = 'c1'", True),
    "trace_upstream": _trace("n = 't:l6.t50' AND k = 'c2'", False),
    "trace_table_downstream": _trace("n = 't:l0.t3'", True, False),
    "trace_wildcard_bridge": f"WITH {_E}{_DOWN} SELECT sn AS source_node, sk AS source_key, tn AS target_node, tk AS target_key FROM bridge",
    "search_tables": f"WITH {_M}, d AS (SELECT source_schema || '.' || source_table AS display FROM maps UNION SELECT target_schema || '.' || target_table FROM maps) SELECT display FROM d WHERE lower(display) LIKE '%t1%' ORDER BY lower(display) LIMIT 50",
    "search_columns": f"WITH {_M}, d AS (SELECT {_LABEL} AS display FROM maps UNION SELECT {_LABEL2} FROM maps) SELECT display FROM d WHERE lower(display) LIKE '%t2%' ORDER BY lower(display) LIMIT 50",
    "mapping_steps": f"{_STEPS} SELECT source_schema, source_table, step_number, count(*) AS n FROM stepped GROUP BY ALL",
    "column_lineage_report": f"{_STEPS} SELECT DISTINCT step_number, package_id, task_id, {_LABEL} AS source_label, {_LABEL2} AS target_label, operation_type FROM stepped",
    "table_risk_scores": f"{_RISK} SELECT table_name, score, level, fan_out_score, depth_score, shared_score, mapping_score, downstream_tables, writer_packages, reader_packages, depth, mapping_count, is_final_target FROM levels",
    "table_risk_levels": f"{_RISK} SELECT level, count(*) AS n_tables, avg(score) AS average_score FROM levels GROUP BY 1",
    "packages_writing_to_table": f"WITH {_M} " + _PACKAGES.format("Writer", "lower(target_schema || '.' || target_table) = 'l3.t25' OR target_table LIKE '%l3.t25%'"),
    "packages_reading_from_table": f"WITH {_M} " + _PACKAGES.format("Reader", "lower(source_table) LIKE '%t11%'"),
    "packages_using_column": f"WITH {_M} " + _PACKAGES.format("Package", "source_column = 'c3' OR target_column = 'c3'"),
    "high_fanout_columns": f"WITH {_M} SELECT {_LABEL} AS \"primary\", '' AS secondary, 'High Fanout' AS category, count(*) AS n FROM maps GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, 1 LIMIT 30",
    "orphan_tables": f"WITH {_M} SELECT DISTINCT lower(target_schema || '.' || target_table) AS \"primary\", '' AS secondary, 'Orphan' AS category, CAST(1 AS BIGINT) AS n FROM maps WHERE lower(target_schema || '.' || target_table) NOT IN (SELECT lower(source_schema || '.' || source_table) FROM maps)",
    "package_inventory": f"WITH {_M} SELECT package_id AS \"primary\", count(DISTINCT task_id) || ' tasks' AS secondary, 'Package' AS category, count(*) AS n FROM maps GROUP BY 1",
    "table_mappings": f"WITH {_M} SELECT DISTINCT {_LABEL} AS \"primary\", {_LABEL2} AS secondary, operation_type AS category, CAST(1 AS BIGINT) AS n FROM maps WHERE source_table LIKE '%t9%' OR target_table LIKE '%t9%' ORDER BY 1, 2, 3 LIMIT 100",
    "column_sources": f"WITH {_M} SELECT DISTINCT {_LABEL} AS \"primary\", package_id || ' / ' || task_id AS secondary, 'Source' AS category, CAST(1 AS BIGINT) AS n FROM maps WHERE target_table LIKE '%t17%'",
    "column_targets": f"WITH {_M} SELECT DISTINCT {_LABEL2} AS \"primary\", package_id || ' / ' || task_id AS secondary, 'Target' AS category, CAST(1 AS BIGINT) AS n FROM maps WHERE source_table LIKE '%t9%'",
    "question_answer": f"WITH {_M} " + _PACKAGES.format("Writer", "lower(target_table) LIKE '%t12%'"),
    "rename_edges": f"WITH {_M} SELECT {_LABEL} AS source_label, {_LABEL2} AS target_label, count(*) AS n FROM maps WHERE source_column <> '*' AND target_column <> '*' AND source_column <> target_column GROUP BY ALL",
    "impact_drop_column": _impact("Critical", "source_table = 't18' AND source_column = 'c1'", "target_table = 't18' AND target_column = 'c1'", True),
    "impact_rename_column": _impact("Critical", "source_table = 't20' AND source_column = 'c2'", "target_table = 't20' AND target_column = 'c2'", True),
    "impact_drop_table": _impact("Critical", "source_table = 't33'", "target_table = 't33'", False),
    "impact_change_type": _impact("Warning", "source_table = 't26' AND source_column = 'c0'", "target_table = 't26' AND target_column = 'c0' AND NOT (source_table = 't26' AND source_column = 'c0')", True),
    "impact_checklist": f"WITH {_M} SELECT DISTINCT 1 AS priority, 'Remove L4.t34 from' AS action, package_id || ' / ' || task_id AS target FROM maps WHERE source_table = 't34' OR target_table = 't34'",
    "contract_columns": f"WITH {_M} SELECT lower(target_schema || '.' || target_table) AS table_name, lower(target_column) AS column_name, count(*) AS n_maps FROM maps WHERE target_column <> '*' GROUP BY ALL",
    "contract_violations": f"""WITH {_M}, actual AS (SELECT DISTINCT lower(target_schema || '.' || target_table) AS t, lower(target_column) AS c FROM maps WHERE target_column <> '*'),
 spec(t, c, r) AS (VALUES ('l1.t8', 'c0', true), ('l1.t8', 'c9', true), ('l2.t17', 'c1', false), ('l9.t99', 'c0', true), ('l3.t25', 'c0', true), ('l3.t25', 'c8', false))
SELECT DISTINCT t AS table_name, '' AS column_name, 'Breaking' AS severity, 'table missing' AS reason FROM spec WHERE t NOT IN (SELECT t FROM actual)
UNION ALL SELECT t, c, 'Breaking', 'column missing' FROM spec WHERE r AND t IN (SELECT t FROM actual) AND (t, c) NOT IN (SELECT (t, c) FROM actual)
UNION ALL SELECT t, c, 'Additive', 'new column' FROM actual WHERE t IN (SELECT t FROM spec) AND (t, c) NOT IN (SELECT (t, c) FROM spec)""",
    "lineage_diff": f"""WITH {_M}, keys AS (SELECT package_id, 'package' AS kind, lower(package_id) AS key FROM maps UNION SELECT package_id, 'task', lower(package_id || '/' || task_id) FROM maps
 UNION SELECT package_id, 'mapping', lower({_LABEL} || ' -> ' || {_LABEL2} || ' [' || operation_type || ']') FROM maps),
 a AS (SELECT DISTINCT kind, key FROM keys WHERE package_id <> 'pkg_3'), b AS (SELECT DISTINCT kind, key FROM keys WHERE package_id <> 'pkg_5')
SELECT kind, 'added' AS change, key FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT kind, 'removed', key FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "object_edge_counts": f"WITH {_M}, w AS (SELECT 'writes' AS rel, task_id AS src, target_schema || '.' || target_table AS dst, count(*) AS n FROM maps GROUP BY ALL) SELECT DISTINCT 'contains' AS rel, package_id AS src, task_id AS dst, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_out FROM maps UNION ALL SELECT *, count(*) OVER (PARTITION BY src) FROM w",
    "mermaid_edges": f"WITH {_M} SELECT DISTINCT source_schema || '.' || source_table AS src, target_schema || '.' || target_table AS dst, replace(regexp_replace(operation_type, '^SQL_PROC_', ''), '_', ' ') AS op FROM maps",
    "openlineage_inputs": f"WITH {_M} SELECT task_id, target_schema || '.' || target_table AS output, target_column AS field, string_agg(DISTINCT {_LABEL}, ',' ORDER BY {_LABEL}) AS input_fields FROM maps WHERE target_column <> '*' GROUP BY ALL",
    "summary_tiles": f"WITH {_M} SELECT 'maps' AS tile, CAST(count(*) AS BIGINT) AS n FROM maps UNION ALL SELECT 'packages', count(DISTINCT package_id) FROM maps UNION ALL SELECT 'tasks', count(DISTINCT task_id) FROM maps UNION ALL SELECT 'source_tables', count(DISTINCT source_schema || source_table) FROM maps UNION ALL SELECT 'target_tables', count(DISTINCT target_schema || target_table) FROM maps UNION ALL SELECT 'operations', count(DISTINCT operation_type) FROM maps",
    "drill_down_task": f"WITH {_M} SELECT DISTINCT {_LABEL} AS source, {_LABEL2} AS target, operation_type FROM maps WHERE task_id = 'task_3_2' ORDER BY 1, 2, 3 LIMIT 500",
    "complete_columns": f"WITH {_M} SELECT source_column AS choice FROM maps WHERE source_table = 't18' AND source_column LIKE '%c%' UNION SELECT target_column FROM maps WHERE target_table = 't18' AND target_column LIKE '%c%'",
    "package_effort": f"WITH {_M}, c AS (SELECT package_id, count(*) AS n_components FROM (SELECT DISTINCT package_id, task_id, target_table FROM maps) GROUP BY 1), d AS (SELECT *, greatest(1, CAST(floor(n_components * 1.5) AS INTEGER)) AS person_days FROM c) SELECT *, CASE WHEN person_days <= 5 THEN 'S' WHEN person_days <= 15 THEN 'M' WHEN person_days <= 40 THEN 'L' ELSE 'XL' END AS size FROM d",
    "narratives": f"""WITH {_M}, v AS (SELECT package_id, task_id, source_table AS s, target_table AS t, CASE WHEN operation_type LIKE '%INSERT%' THEN 'loads' ELSE 'derives columns of' END AS v FROM maps)
SELECT package_id, task_id, 'This task ' || string_agg(DISTINCT v, ' and ' ORDER BY v) || ' ' || string_agg(DISTINCT t, ', ' ORDER BY t) || ' from ' || string_agg(DISTINCT s, ', ' ORDER BY s) || ', ' || count(*) || ' column mappings.' AS narrative FROM v GROUP BY ALL""",
    "task_recommendations": f"WITH {_TASKS} SELECT task_id, ['Data Flow Task', 'Execute SQL Task', 'Execute Package Task'][k % 3 + 1] AS usual_type, ['dbt Model (SQL)', 'dbt pre/post-hook or PythonOperator', 'Airflow SubDAG or TriggerDagRunOperator'][k % 3 + 1] AS recommendation FROM timed",
    "tsql_lineage_records": """SELECT 'INSERT' AS operation_type, 'O' || o_custkey % 7 AS source_table, 'k' AS source_column, 'dw' AS target_schema, 'Fact_' || o_orderstatus AS target_table, 'k' AS target_column, 'o.k' AS source_expression, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'INSERT', 'C', 'v', 'dw', 'Fact_' || o_orderstatus, 'v', 'c.v * 2', count(*) FROM orders GROUP BY ALL""",
    "task_duration_estimates": f"WITH {_TASKS} SELECT task_id, package_id, seconds, CASE WHEN seconds >= 300 THEN 'High' WHEN seconds >= 120 THEN 'Medium' ELSE 'Low' END AS level, reason FROM timed",
    "critical_path_distances": f"WITH RECURSIVE {_TASKS}, walk(task_id, package_id, k, seconds, finish) AS (SELECT task_id, package_id, k, seconds, seconds FROM timed UNION SELECT t.task_id, t.package_id, t.k, t.seconds, w.finish + t.seconds FROM walk w JOIN timed t ON t.package_id = w.package_id AND t.k = w.k + 1) SELECT task_id, seconds, max(finish) AS finish FROM walk GROUP BY 1, 2",
    "critical_path": f"""WITH RECURSIVE {_TASKS}, walk(task_id, package_id, k, seconds, finish) AS (SELECT task_id, package_id, k, seconds, seconds FROM timed UNION SELECT t.task_id, t.package_id, t.k, t.seconds, w.finish + t.seconds FROM walk w JOIN timed t ON t.package_id = w.package_id AND t.k = w.k + 1) 
, ends AS (SELECT task_id, package_id, k, max(finish) AS finish FROM walk GROUP BY ALL),
 back(task_id, package_id, k, finish) AS (SELECT * FROM (SELECT * FROM ends ORDER BY finish DESC, task_id LIMIT 1)
  UNION ALL SELECT e.task_id, e.package_id, e.k, e.finish FROM back b JOIN ends e ON e.package_id = b.package_id AND e.k = b.k - 1)
SELECT row_number() OVER (ORDER BY finish) AS place, task_id FROM back""",
    "candidate_table_resolution": """WITH lists AS (SELECT DISTINCT source_table, source_column_name AS source_column FROM column_map WHERE source_table LIKE '%|%'),
 owned AS (SELECT DISTINCT lower(trim(source_table)) AS t, lower(trim(source_column_name)) AS c FROM column_map WHERE source_table NOT LIKE '%|%'),
 parts AS (SELECT source_table, source_column, unnest(string_split_regex(source_table, '\\s*\\|\\s*')) AS candidate FROM lists),
 found AS (SELECT source_table, source_column, count(*) AS n, min(candidate) AS one FROM parts JOIN owned ON lower(trim(candidate)) = t AND lower(trim(source_column)) = c GROUP BY 1, 2)
SELECT l.source_table, l.source_column, coalesce(n, 0) AS n_owners, CASE WHEN n = 1 THEN trim(one) ELSE l.source_table END AS resolved_table
FROM lists l LEFT JOIN found f ON f.source_table = l.source_table AND f.source_column = l.source_column""",
    "linked_server_rewrite": """WITH s(name, data) AS (VALUES ('srv-kop03', 'staging-a'), ('srv-kop05', 'staging-b'), ('srv-dw01', 'warehouse'))
SELECT coalesce(a.data, source_server) AS source_server, coalesce(b.data, target_server) AS target_server, count(*) AS n
FROM column_map LEFT JOIN s a ON a.name = lower(source_server) LEFT JOIN s b ON b.name = lower(target_server) GROUP BY 1, 2""",
    "operation_labels": "SELECT operation_type, replace(replace(regexp_replace(operation_type, '^SQL_PROC_', ''), 'XML_FALLBACK', 'DATA FLOW'), '_', ' ') AS op_label, count(*) AS n FROM column_map GROUP BY 1",
    "redacted_text": f"SELECT doc_id, regexp_replace(coalesce(text, '') || ' Server=a;Password=p' || doc_id || ';token = t;User=' || coalesce(source, ''), '\\b({etl.SECRETS})([\\t\\n\\v\\f\\r ]*=[\\t\\n\\v\\f\\r ]*)[^;\"''\\t\\n\\v\\f\\r <>&]+', '\\1\\2***REDACTED***', 'gi') AS redacted FROM documents",
    "component_type_normalization": """WITH r AS (SELECT p_partkey, ['Microsoft.DerivedColumn', 'OLEDBSource.2', 'Lookup', '{1F-2A}', 'TxScript', '', 'SortTransform', 'Aggregate', 'FlatFile'][p_partkey % 9 + 1] AS raw, 'Part ' || p_size AS name FROM part),
 t AS (SELECT p_partkey, CASE WHEN raw = 'TxScript' THEN 'Script Component' WHEN raw = '{1F-2A}' THEN 'Third-Party: ' || name WHEN raw = '' THEN 'Component' WHEN raw LIKE '%DerivedColumn%' THEN 'Derived Column'
  WHEN raw LIKE 'OLEDBSource%' THEN 'OLE DB Source' WHEN raw = 'SortTransform' THEN 'Sort' ELSE raw END AS c FROM r)
SELECT p_partkey, c AS component_type, CASE WHEN c LIKE '%Source%' THEN 'Python Extraction (pyodbc/pandas)' WHEN c IN ('Derived Column', 'Lookup', 'Aggregate') THEN 'dbt Model (SQL)' WHEN c = 'Sort' THEN 'dbt Model (ORDER BY)'
 WHEN c = 'Script Component' THEN 'Python / PySpark' ELSE 'dbt Transformation' END AS advice FROM t""",
}
