"""Queries over reports, resolution of open ends, questions and T-SQL statements, with the SQL they match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import sqltext
from weftline.lineage_queries import _DOWN, _E, _LABEL, _LABEL2, _M, _PACKAGES, _RISK, _STEPS, _diff, _on, _real_maps, _tasks
from weftline.lineage_queries import ORACLE as _KNOWN
from weftline.operators import lineage as L
from weftline.operators import questions as Q
from weftline.operators import resolve as R
from weftline.session import table
from weftline.sinks import exports, reports
from weftline.sources import tsql

Query = Callable[[SparkSession, str], DataFrame]


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("line")


def _targets(term: str) -> Query:
    return _on(lambda m: R.target_resolution(m, term))


def _matches(maps: DataFrame) -> DataFrame:
    """Edges that write the ids of tasks in other ways: in braces, with a prefix, with their package."""
    tasks, _, edges = _tasks(maps)
    written = edges.select(F.concat(F.lit("{"), F.upper("src"), F.lit("}")).alias("src"), F.concat(F.lit("Pkg::Package\\"), "dst").alias("dst"))
    return R.task_matches(tasks, written.union(edges.select("src", F.lit("unknown"))))


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servers and databases of the target components in column_map; every component that only one package has knows its own."""
    maps = _real_maps(spark, sf_dir)
    c = maps.where(L.text("target_component_id") != "").groupBy(F.col("target_component_id").alias("component_id")).agg(F.min("package_id").alias("package_id"), F.min("source_database").alias("database"), F.min("source_server").alias("server"), F.count_distinct("target_table").alias("n"))
    own = F.when(F.col("n") == 1, F.col("database"))
    found = R.servers_and_databases(c.select("component_id", "package_id", own.alias("database"), "server"), maps, "target", ("host", "db"))
    return found


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    packages = n.select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("package_id"), F.concat(F.lit("Pkg_"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(".dtsx")).alias("name"))
    tasks = n.select(
        F.col("n_nationkey").alias("task_id"), F.when(F.col("n_regionkey") == 4, F.concat(F.lit("Execute_Own"), F.col("n_nationkey").cast("string"))).otherwise(F.concat(F.lit("Execute Task "), "n_name")).alias("name"),
        F.when(F.col("n_regionkey") == 1, F.concat(F.lit("x\\Pkg_Of "), "n_name", F.lit(".dtsx"))).alias("description"),
    )
    invokes = n.where("n_regionkey = 0").select(F.col("n_nationkey").alias("src"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("dst"))
    return R.child_dags(tasks, packages, invokes)


def _escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "column_map")
    sql = F.concat(F.lit("SELECT user.a FROM external."), L.text("source_table"), F.lit(" JOIN ORDER.x ON keys.b = Value.c AND "), L.text("filter_conditions"))
    return m.select("map_id", sqltext.escape_reserved(sql).alias("escaped"))


#: T-SQL statements of all kinds and the records (operation, source table and column, target table and
#: column) that they give.
STATEMENTS: list[tuple[str, list[tuple[str, str, str, str, str]]]] = [
    ("CREATE PROCEDURE dbo.p AS BEGIN INSERT INTO z (q) SELECT t.a FROM t END", [("INSERT", "t", "a", "z", "q")]),
    ("IF 1 = 1 BEGIN INSERT INTO z (q) SELECT a FROM t END ELSE INSERT INTO y (q) SELECT b FROM u", [("INSERT", "t", "a", "z", "q"), ("INSERT", "u", "b", "y", "q")]),
    ("WHILE @i < 3 BEGIN INSERT INTO z (q) SELECT a FROM t SET @i = @i + 1 END", [("INSERT", "t", "a", "z", "q")]),
    ("BEGIN TRY INSERT INTO z (q) SELECT a FROM t END TRY BEGIN CATCH INSERT INTO e (m) SELECT b FROM u END CATCH", [("INSERT", "t", "a", "z", "q")]),
    ("DECLARE @t varchar(9) = 'src'; DECLARE @s varchar(99) = 'SELECT * INTO tgt FROM ' + @t; EXEC(@s)", [("SELECTINTO", "src", "*", "tgt", "*")]),
    ("INSERT INTO y EXEC hr.z", [("INSERT_EXEC", "z", "*", "y", "*")]),
    ("DELETE d FROM dbo.D d JOIN y ON y.i = d.i", [("DELETE", "D", "", "D", "")]),
    ("SELECT a INTO n FROM o", [("SELECTINTO", "o", "a", "n", "a")]),
    ("SELECT a INTO n FROM O, C, I", [("SELECTINTO", "O | C | I", "a", "n", "a")]),
    ("UPDATE t SET t.v = s.w FROM T t JOIN S s ON s.i = t.i", [("UPDATE", "S", "w", "T", "v")]),
    ("MERGE dw.P AS T USING dbo.S AS S ON T.Id = S.Id WHEN MATCHED THEN UPDATE SET T.N = S.N WHEN NOT MATCHED THEN INSERT (Id, N) VALUES (S.Id, S.N);", [("MERGE-UPDATE", "S", "N", "P", "N"), ("MERGE-INSERT", "S", "Id", "P", "Id"), ("MERGE-INSERT", "S", "N", "P", "N")]),
    ("WITH c AS (SELECT a FROM t) INSERT INTO z (q) SELECT a FROM c", [("CTE", "t", "a", "c", "a"), ("INSERT", "c", "a", "z", "q")]),
    ("INSERT INTO z (a) SELECT x.a FROM OPENQUERY(L, 'SELECT a FROM far.T') x", [("INSERT", "T", "a", "z", "a")]),
    ("INSERT INTO z (q) SELECT x.a FROM (SELECT a FROM inner_t) x", [("DERIVED", "inner_t", "a", "x", "a"), ("INSERT", "x", "a", "z", "q")]),
    ("INSERT INTO z SELECT * FROM t", [("INSERT", "t", "*", "z", "*")]),
    ("INSERT INTO z (q) SELECT a FROM t UNION ALL SELECT b FROM u", [("INSERT", "t", "a", "z", "q"), ("INSERT", "u", "b", "z", "q")]),
    ("INSERT INTO t SELECT a FROM [L].[Db].[sc].[T 1]", [("INSERT", "T 1", "a", "t", "a")]),
]


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = spark.createDataFrame([(n, sql) for n, (sql, _) in enumerate(STATEMENTS)], "statement long, sql string")
    return tsql.lineage_records(scripts, ["statement"], "sql").select("statement", "operation_type", "source_table", "source_column", "target_table", "target_column")


def _values() -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    rows = [f"({n}, {', '.join(map(quoted, r))})" for n, (_, records) in enumerate(STATEMENTS) for r in records]
    return f"SELECT CAST(statement AS BIGINT) AS statement, operation_type, source_table, source_column, target_table, target_column FROM (VALUES {', '.join(rows)}) t(statement, operation_type, source_table, source_column, target_table, target_column)"


def _asked(question: str, strict: bool = False) -> Query:
    return _on(lambda m: Q.answer(m, question, strict))


QUERIES: dict[str, Query] = {
    "question_column_source": _asked("where does t17 come from"),
    "question_column_target": _asked("downstream of t9"),
    "question_packages_reading": _asked("read from t11"),
    "question_high_fanout": _asked("columns most used more than 5 times"),
    "question_orphans": _asked("tables with no downstream", True),
    "question_packages": _asked("list packages"),
    "question_packages_using": _asked("what package uses c3"),
    "question_mappings": _asked("mapping of t9"),
    "question_search": _asked("t9"),
    "impact_counters": _on(lambda m: R.impact_counters(L.impact(m, "drop_table", "L4.t33"))),
    "trace_table_count": _on(lambda m: R.trace_tables(L.trace(m, "L0.t3", "c1", "down"))),
    "target_resolution_exact": _targets("l2.T18"),
    "target_resolution_first": _targets("t2"),
    "palette_items": _on(lambda m: R.palette(m, "t1", 25)),
    "task_matches": _on(_matches),
    "servers_and_databases": _owners,
    "child_dag_ids": _children,
    "escaped_sql": _escaped,
    "server_addresses": lambda spark, sf_dir: table(spark, sf_dir, "column_map").select("source_server", sqltext.server_address(F.col("source_server")).alias("address")).distinct(),
    "risk_report": _on(lambda m: _lines(reports.risk_markdown(L.risk_scores(m)))),
    "whatif_report": _on(lambda m: _lines(reports.whatif_markdown(L.impact(m, "drop_table", "L4.t34"), L.checklist(L.impact(m, "drop_table", "L4.t34"), "drop_table", "L4.t34"), "drop_table", "L4.t34"))),
    "diff_report": _on(lambda m: _lines(reports.diff_markdown(_diff(m)))),
    "lineage_diff_components": _on(lambda m: L.graph_diff(m.limit(0), m.limit(0), _parts(m, "pkg_3"), _parts(m, "pkg_5"))),
    "lineage_export": _on(lambda m: _lines(reports.lineage_export(m))),
    "trace_export": _on(lambda m: _lines(reports.trace_export(m, L.trace(m, "L4.t33", "c1", "down")))),
    "graph_summary": _on(lambda m: reports.summary(m, components=_tasks(m)[1], executions=_tasks(m)[2])),
    "column_diagram": _on(lambda m: reports.column_diagram(m)),
    "csv_lines": _on(lambda m: _lines(exports.lineage_csv(m.select("package_id", "target_table").distinct()))),
    "tsql_statements": _statements,
}


def _parts(maps: DataFrame, but: str) -> DataFrame:
    return _tasks(maps)[1].where(F.col("package_id") != but).withColumn("name", F.concat(F.lit("c_"), "type"))


_CELL = "'\"' || replace(coalesce({0}, ''), '\"', '\"\"') || '\"'"
_SIDE = "CASE WHEN lower(source_column) <> lower(target_column) AND source_column <> '*' AND target_column <> '*' THEN source_column || ' -> ' || target_column ELSE '' END"


def _line(*cells: str) -> str:
    return " || ',' || ".join(_CELL.format(c) for c in cells)


_BLANK = "''"
_T9 = f"WITH {_M} SELECT DISTINCT {_LABEL} AS \"primary\", {_LABEL2} AS secondary, operation_type AS category, CAST(1 AS BIGINT) AS n FROM maps WHERE source_table LIKE '%t9%' OR target_table LIKE '%t9%' ORDER BY 1, 2, 3 LIMIT "
_RANKS = "depth(n, d) AS (SELECT DISTINCT s, 0 FROM tables UNION SELECT t.t, d + 1 FROM depth JOIN tables t ON t.s = depth.n WHERE t.s <> t.t), ranks AS (SELECT n, max(d) AS d FROM depth GROUP BY n)"
_SEARCH = f"WITH {_M}, t AS (SELECT source_schema || '.' || source_table AS d FROM maps UNION SELECT target_schema || '.' || target_table FROM maps), c AS (SELECT {_LABEL} AS d FROM maps UNION SELECT {_LABEL2} FROM maps)"
ORACLE: dict[str, str] = {
    "question_column_source": _KNOWN["column_sources"],
    "question_column_target": _KNOWN["column_targets"],
    "question_packages_reading": _KNOWN["packages_reading_from_table"],
    "question_high_fanout": _KNOWN["high_fanout_columns"],
    "question_orphans": _KNOWN["orphan_tables"],
    "question_packages": _KNOWN["package_inventory"],
    "question_packages_using": f"WITH {_M} " + _PACKAGES.format("Package", "source_column = 'c3' OR target_column = 'c3'"),
    "question_mappings": _T9 + "100",
    "question_search": _T9 + "100",
    "impact_counters": f"WITH {_M}, f AS (SELECT 's' AS side, package_id, task_id FROM maps WHERE source_table = 't33' UNION SELECT 't', package_id, task_id FROM maps WHERE target_table = 't33') SELECT count(DISTINCT package_id) AS packages, count(*) AS mappings, CAST(0 AS BIGINT) AS procedures, CAST(0 AS BIGINT) AS tasks, count(*) > 0 AS has_critical FROM f",
    "trace_table_count": f"WITH t AS ({_KNOWN['trace_downstream']}) SELECT count(*) AS n_tables FROM (SELECT source_node FROM t UNION SELECT target_node FROM t)",
    "target_resolution_exact": f"{_SEARCH} SELECT 'table' AS scope, d AS display FROM t WHERE lower(d) = 'l2.t18'",
    "target_resolution_first": f"{_SEARCH} SELECT 'column' AS scope, d AS display FROM c WHERE d LIKE '%t2%' ORDER BY lower(d) LIMIT 1",
    "palette_items": f"WITH {_M}, i AS (SELECT 'package' AS kind, package_id AS item FROM maps UNION SELECT 'table', target_schema || '.' || target_table FROM maps UNION SELECT 'column', {_LABEL2} FROM maps) SELECT kind, item FROM i WHERE lower(item) LIKE '%t1%' ORDER BY kind, lower(item), item LIMIT 25",
    "task_matches": f"WITH {_M}, own AS (SELECT DISTINCT package_id, task_id, CAST(split_part(task_id, '_', 3) AS INTEGER) AS k FROM maps) SELECT DISTINCT a.task_id AS src, b.task_id AS dst FROM own a JOIN own b ON a.package_id = b.package_id AND b.k = a.k + 1",
    "servers_and_databases": """WITH c AS (SELECT target_component_id AS id, min(package_id) AS p, CASE WHEN count(DISTINCT target_table) = 1 THEN nullif(min(source_database), '') END AS d, coalesce(min(source_server), '') AS s FROM column_map WHERE target_component_id <> '' GROUP BY 1),
 k AS (SELECT package_id AS p, target_component_id AS id, target_database AS d, coalesce(target_server, '') AS s FROM column_map WHERE target_database <> ''),
 t2 AS (SELECT id, min((d, s)) AS f FROM k WHERE id <> '' GROUP BY 1), t3 AS (SELECT p, min((d, s)) AS f FROM k GROUP BY 1),
 t4 AS (SELECT p, min((d, s)) AS f FROM c WHERE d IS NOT NULL GROUP BY 1), t5 AS (SELECT min((d, s)) AS f FROM k)
SELECT c.id AS component_id, CASE WHEN c.d IS NOT NULL THEN c.s ELSE coalesce(t2.f[2], t3.f[2], t4.f[2], t5.f[2], 'host') END AS server, coalesce(c.d, t2.f[1], t3.f[1], t4.f[1], t5.f[1], 'db') AS database,
 CASE WHEN c.d IS NOT NULL THEN 1 WHEN t2.f IS NOT NULL THEN 2 WHEN t3.f IS NOT NULL THEN 3 WHEN t4.f IS NOT NULL THEN 4 WHEN t5.f IS NOT NULL THEN 5 ELSE 6 END AS tier
FROM c LEFT JOIN t2 ON t2.id = c.id LEFT JOIN t3 ON t3.p = c.p LEFT JOIN t4 ON t4.p = c.p CROSS JOIN t5""",
    "child_dag_ids": """SELECT n_nationkey AS task_id, CASE n_regionkey WHEN 0 THEN 'dag_' || replace(lower(n_name), ' ', '_') WHEN 1 THEN 'dag_of_' || replace(lower(n_name), ' ', '_') WHEN 4 THEN 'dag_own' || n_nationkey
 ELSE coalesce((SELECT 'dag_' || replace(lower(p.n_name), ' ', '_') FROM nation p WHERE contains(lower(p.n_name), lower(n.n_name)) ORDER BY length(p.n_name), p.n_name LIMIT 1), '') END AS dag_id, CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 4 ELSE 3 END AS tier FROM nation n""",
    "escaped_sql": "SELECT map_id, regexp_replace('SELECT user.a FROM external.' || coalesce(source_table, '') || ' JOIN ORDER.x ON keys.b = Value.c AND ' || coalesce(filter_conditions, ''), '\\b(" + "|".join(sqltext.RESERVED) + ")\\.', '[\\1].', 'gi') AS escaped FROM column_map",
    "server_addresses": "SELECT DISTINCT source_server, CASE WHEN trim(coalesce(source_server, '')) IN ('', '.') OR lower(source_server) LIKE 'localhost%' THEN '172.17.0.1,1433' WHEN source_server LIKE '%,%' THEN source_server ELSE source_server || ',1433' END AS address FROM column_map",
    "risk_report": f"""{_RISK}, heads(line) AS (VALUES ('# Risk report'), (''), ('## Summary'), (''), ('| Level | Count |'), ('|---|---|'), (''), ('## Tables'), (''), ('| Table | Score | Level | Fan-out | Depth | Shared by | Mappings |'), ('|---|---|---|---|---|---|---|'))
SELECT line FROM heads UNION ALL SELECT '| ' || l || ' | ' || (SELECT count(*) FROM levels WHERE level = split_part(l, ' ', 1)) || ' |' FROM (VALUES ('Critical (75 and more)'), ('High (50-74)'), ('Medium (25-49)'), ('Low (0-24)')) v(l)
UNION ALL SELECT '| Average score | ' || round(avg(score), 1) || ' |' FROM levels
UNION ALL SELECT '| ' || table_name || ' | ' || score || ' | ' || level || ' | ' || downstream_tables || ' | ' || depth || ' | ' || reader_packages || ' | ' || mapping_count || ' |' FROM levels""",
    "whatif_report": f"""WITH {_M}, f AS (SELECT 'source' AS side, package_id, task_id FROM maps WHERE source_table = 't34' UNION SELECT 'target', package_id, task_id FROM maps WHERE target_table = 't34'),
 heads(line) AS (VALUES ('# What-if simulation'), (''), ('## Proposed changes'), (''), ('- Drop table **L4.t34**'), (''), ('## Impact summary'), (''), ('| Metric | Count |'), ('|---|---|'), (''), ('## Findings'), (''), ('| Severity | Category | Location | Description |'), ('|---|---|---|---|'), (''), ('## Checklist'), (''))
SELECT line FROM heads UNION ALL SELECT '| Affected packages | ' || count(DISTINCT package_id) || ' |' FROM f UNION ALL SELECT '| Broken column mappings | ' || count(*) || ' |' FROM f
UNION ALL SELECT '| Stored procedures to review | 0 |' UNION ALL SELECT '| Tasks affected | 0 |'
UNION ALL SELECT '| Critical | Column Mapping | ' || package_id || ' / ' || task_id || ' | ' || side || '  |' FROM f
UNION ALL SELECT DISTINCT '- **[Required]** Remove L4.t34 from `' || package_id || ' / ' || task_id || '`' FROM f""",
    "diff_report": f"""WITH d AS ({_KNOWN['lineage_diff']}) SELECT '# Lineage diff' AS line UNION ALL SELECT '' UNION ALL SELECT '**' || count(*) || ' change(s) detected.**' FROM d
UNION ALL SELECT '## ' || CASE kind WHEN 'package' THEN 'Packages' WHEN 'task' THEN 'Tasks' ELSE 'Column mappings' END || ' ' || change || ' (' || count(*) || ')' FROM d GROUP BY kind, change UNION ALL SELECT '- ' || key FROM d""",
    "lineage_diff_components": f"""WITH {_M}, c AS (SELECT DISTINCT package_id, lower(package_id || '/' || task_id || '/c_' || t || ' [' || t || ']') AS key FROM (SELECT DISTINCT package_id, task_id, ['Lookup', 'OLE DB Source', 'Sort', 'OLE DB Destination', 'Aggregate', 'Derived Column'][CAST(split_part(task_id, '_', 3) AS INTEGER) + 1] AS t FROM maps))
SELECT 'component' AS kind, CASE package_id WHEN 'pkg_3' THEN 'added' ELSE 'removed' END AS change, key FROM c WHERE package_id IN ('pkg_3', 'pkg_5')""",
    "lineage_export": f"{_STEPS} SELECT '{','.join(reports.LINEAGE_COLUMNS)}' AS line UNION ALL SELECT {_line('CAST(step_number AS VARCHAR)', 'package_id', 'task_id', *[_BLANK] * 3, 'source_schema', 'source_table', 'source_column', *[_BLANK] * 3, 'target_schema', 'target_table', 'target_column', 'operation_type', *[_BLANK] * 2)} FROM stepped",
    "trace_export": f"""WITH RECURSIVE {_E}{_DOWN}, hops AS (SELECT * FROM edges UNION SELECT * FROM bridge),
 reached(n, k) AS (SELECT n, k FROM known WHERE n = 't:l4.t33' AND k = 'c1' UNION SELECT h.tn, h.tk FROM reached r JOIN hops h ON h.sn = r.n AND h.sk = r.k),
 used AS (SELECT e.* FROM edges e JOIN reached r ON r.n = e.sn AND r.k = e.sk UNION SELECT b.sn, '*', b.tn, '*' FROM bridge b JOIN reached r ON r.n = b.sn AND r.k = b.sk),
 pairs AS (SELECT DISTINCT sn || '|' || sk AS s, tn || '|' || tk AS t FROM used), depth(n, d) AS (SELECT s, 0 FROM pairs UNION SELECT p.t, d + 1 FROM depth JOIN pairs p ON p.s = depth.n), ranks AS (SELECT n, max(d) AS d FROM depth GROUP BY n)
SELECT '{','.join(reports.TRACE_COLUMNS)}' AS line UNION ALL SELECT {_line('CAST(r.d + 1 AS VARCHAR)', *[_BLANK] * 2, 'source_schema', 'source_table', 'source_column', 'operation_type', _SIDE, *[_BLANK] * 4, 'target_schema', 'target_table', 'target_column', 'package_id', 'task_id', *[_BLANK] * 2)}
FROM maps m JOIN used u ON u.sn = 't:' || lower(source_schema || '.' || source_table) AND u.sk = lower(source_column) AND u.tn = 't:' || lower(target_schema || '.' || target_table) AND u.tk = lower(target_column) JOIN ranks r ON r.n = u.sn || '|' || u.sk""",
    "graph_summary": f"""WITH {_M}, t AS (SELECT DISTINCT package_id AS p, task_id AS i, CAST(split_part(task_id, '_', 3) AS INTEGER) AS k FROM maps), n AS (SELECT count(DISTINCT p) AS p, count(*) AS t FROM t), e AS (SELECT count(*) AS e FROM t a JOIN t b ON a.p = b.p AND b.k = a.k + 1)
SELECT 'packages' AS tile, p AS n FROM n UNION ALL SELECT 'tasks', t FROM n UNION ALL SELECT 'components', t FROM n UNION ALL SELECT 'dataFlowEdges', 0 UNION ALL SELECT 'executionEdges', e FROM e UNION ALL SELECT 'columnMappings', count(*) FROM maps UNION ALL SELECT 'totalNodes', p + 2 * t FROM n UNION ALL SELECT 'totalEdges', e FROM e""",
    "column_diagram": f"""WITH RECURSIVE {_M}, e AS (SELECT DISTINCT source_schema || '.' || source_table AS s, {_LABEL} AS src, target_schema || '.' || target_table AS t, {_LABEL2} AS dst FROM maps), tables AS (SELECT DISTINCT s, t FROM e WHERE src <> dst), {_RANKS},
 placed AS (SELECT n, d, row_number() OVER (PARTITION BY d ORDER BY n) AS place FROM ranks) SELECT src, dst, CAST(d AS BIGINT) AS src_rank, CAST(place AS INTEGER) AS src_place FROM e JOIN placed ON n = s WHERE src <> dst""",
    "csv_lines": f"WITH {_M} SELECT '\"package_id\",\"target_table\"' AS line UNION ALL SELECT DISTINCT '\"' || package_id || '\",\"' || target_table || '\"' FROM maps",
    "tsql_statements": _values(),
}
