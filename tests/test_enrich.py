import json

import pytest

from weftline.operators import enrich, narrative
from weftline.plans import emit
from weftline.plans.dataflow import FlowError
from weftline.sources import cache, packages

FLOW = [
    {"id": "Orders In", "type": "OLE DB Source", "table": "orders"},
    {"id": "Find", "type": "Lookup", "reference": "customer", "keys": {"o_custkey": "c_custkey"}, "columns": {"c_name": "c_name"}},
    {"id": "Calc", "type": "Derived Column", "columns": {"big": '[o_totalprice] > 5 && !ISNULL(c_name) ? "y" : "n"'}},
    {"id": "Split", "type": "Conditional Split", "cases": {"a": '[big] == "y"'}, "default": "rest"},
    {"id": "Sum", "type": "Aggregate", "group": ["c_name"], "aggregates": {"n": ("count", "*"), "d": ("count distinct", "o_orderkey")}},
]
PATHS = [("Orders In", "Find"), ("Find", "Calc"), ("Calc", "Split"), ("Split", "Sum", "a")]


def test_emitted_sql_runs_and_equals_the_flow(spark, data):
    from weftline.plans.dataflow import Flow

    for t in ("orders", "customer"):
        spark.read.parquet(f"{data}/{t}.parquet").createOrReplaceTempView(t)
    sql = emit.sql_model(FLOW, PATHS, "{0}")
    want = Flow(FLOW, PATHS, spark.table).output("Sum")
    assert sorted(map(tuple, spark.sql(sql).collect())) == sorted(map(tuple, want.collect()))
    assert "source('orders')" in emit.sql_model(FLOW, PATHS) and emit.consolidated_sql(FLOW, PATHS, "dw.t").startswith("INSERT INTO dw.t")
    compile(emit.spark_script(FLOW, PATHS, "dw.t"), "script", "exec")
    with pytest.raises(FlowError):
        emit.sql_model([FLOW[0], {**FLOW[1], "keys": {}}], PATHS[:1])


def test_schedules_and_gate():
    tasks, edges = {"Load A": "Execute SQL Task", "2 Flow": "Data Flow Task"}, [("Load A", "2 Flow")]
    dag = emit.airflow_dag("My Dag", tasks, edges)
    compile(dag, "dag", "exec")
    assert "load_a >> _2_flow" in dag and "load_a >> _2_flow" in emit.airflow_dag("x", tasks, [])
    assert json.loads(emit.pipeline_json("p", tasks, edges))["properties"]["activities"][1]["dependsOn"][0]["activity"] == "Load A"
    assert json.loads(emit.job_json("p", tasks, edges))["p"]["_2_flow"]["WaitForEvents"]
    assert emit.quality_gate({"a.sql": "SELECT 1", "b.sql": "x JOIN y ON 1=0", "c": "Password=abc", "d": "(DT_WSTR, 5)x"}) == [("b.sql", "RULE-01", "a join without a key"), ("c", "RULE-04", "a credential"), ("d", "RULE-02", "a cast that wasn't translated")]


def test_procedures_lookups_and_stamps(spark):
    parts = spark.createDataFrame([("p", "t", "c1", "a", "Execute SQL", "EXEC dbo.usp_Load @x = 1", "Dw"), ("p", "t", "c2", "b", "OLE DB Source", "dbo.Orders", "Dw"), ("p", "t", "c3", "L", "Lookup", "[dw].[Dim]", "Dw"), ("p", "t", "c4", "M", "Lookup", "SELECT id, n FROM dw.D2", None)], "package_id string, task_id string, component_id string, name string, type string, sql string, connection string")
    bodies = spark.createDataFrame([("dbo", "USP_LOAD", "CREATE PROCEDURE dbo.usp_Load AS INSERT INTO a.T (x) SELECT y FROM a.S")], "schema_name string, name string, body string")
    made = enrich.procedure_maps(parts, bodies).collect()
    assert [(r["component_id"], r["operation_type"], r["procedure_name"], r["source_column"], r["target_column"]) for r in made] == [("c1", "SQL_PROC_INSERT", "usp_Load", "y", "x")]
    assert {(r["source_schema"], r["source_table"], r["source_column"]) for r in enrich.lookup_references(parts).collect()} == {("dw", "Dim", "*"), ("dw", "D2", "id"), ("dw", "D2", "n")}
    maps = spark.createDataFrame([("C2", "", "", "c9", "kept", "")], "source_component_id string, source_server string, source_database string, target_component_id string, target_server string, target_database string")
    connections = spark.createDataFrame([("DW", "Provider=x;Data Source=srv;Initial Catalog=db")], "id string, connection_string string")
    assert tuple(enrich.stamp(maps, parts, connections).first()) == ("C2", "srv", "db", "c9", "kept", "")
    layers = [spark.createDataFrame(x, "name string, value string") for x in ([("User::A", "1"), ("User::B", "2")], [("user::a", "3")])]
    assert {tuple(r) for r in enrich.layered_variables(layers).collect()} == {("user::a", "3"), ("user::b", "2")}


def test_narratives(spark):
    m = spark.createDataFrame([("p", "t", "s", "simpanan", "a", "dw", "Fact", "b", "SQL_PROC_MERGE-UPDATE")], "package_id string, task_id string, source_schema string, source_table string, source_column string, target_schema string, target_table string, target_column string, operation_type string")
    assert narrative.task_narratives(m).first()["narrative"] == "This task synchronizes Fact from savings, 1 column mappings."
    assert [tuple(r) for r in narrative.drill_down(m, package_id="p").collect()] == [("s.simpanan.a", "dw.Fact.b", "SQL_PROC_MERGE-UPDATE")]
    assert [r["choice"] for r in narrative.complete(m, "FA").collect()] == ["dw.Fact"] and [r["choice"] for r in narrative.complete(m, "", "dw.fact").collect()] == ["b"]
    c = spark.createDataFrame([("p", "c", "X", "Sort")], "package_id string, component_id string, name string, type string")
    assert narrative.component_narratives(c).first()["narrative"] == "X puts rows in order." and tuple(narrative.effort(c).first()) == ("p", 1, 1, "S")
    t = spark.createDataFrame([("t", "Microsoft.Pipeline")], "task_id string, type string")
    assert tuple(narrative.task_recommendations(t).first()) == ("t", "Data Flow Task", "dbt Model (SQL)")


def test_cache_sees_changes(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "A.dtsx").write_text('<Executable DTSID="{A}" ObjectName="A"/>')
    assert [cache.cached_scan(spark, str(tmp_path / "p"), str(tmp_path / "c"))[1] for _ in range(2)] == [False, True]
    (tmp_path / "p" / "B.dtsx").write_text('<Executable DTSID="{B}" ObjectName="B"/>')
    rows, kept = cache.cached_scan(spark, str(tmp_path / "p"), str(tmp_path / "c"))
    assert not kept and rows.where("kind = 'package'").count() == 2 and packages.column_maps(rows).count() == 0
