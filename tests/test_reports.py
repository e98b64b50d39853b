import json
import zipfile

import pytest
from test_sources import PACKAGE

from weftline import cli
from weftline.functions import sqltext
from weftline.operators import lineage as L
from weftline.operators import resolve as R
from weftline.plans import convert as C
from weftline.plans import scan as S
from weftline.sinks import exports, reports
from weftline.sources import connections, loads, packages

LOOKUP = """<component refId="Package\\Seq\\Flow\\Lkp" name="Lkp" componentClassID="Microsoft.Lookup"><properties><property name="SqlCommand">dbo.Names</property></properties><inputs><input refId="Lkp.In"><inputColumns><inputColumn lineageId="L1" cachedName="Id"><properties><property name="JoinToReferenceColumn">NameId</property></properties></inputColumn></inputColumns></input></inputs><outputs><output refId="Lkp.Out"><outputColumns><outputColumn lineageId="L3" name="Label"/></outputColumns></output></outputs></component>"""


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packages")
    text = PACKAGE.replace('<component refId="Package\\Seq\\Flow\\Dst"', LOOKUP + '<component refId="Package\\Seq\\Flow\\Dst"')
    text = text.replace('<inputColumn lineageId="L2" externalMetadataColumnId="Dst.In.ExternalColumns[Doubled]"/>', '<inputColumn lineageId="L2" externalMetadataColumnId="Dst.In.ExternalColumns[Doubled]"/><inputColumn lineageId="L3" externalMetadataColumnId="Dst.In.ExternalColumns[Name]"/>')
    text = text.replace('<path refId="p2" startId="Der.Out" endId="Dst.In" name="b"/>', '<path refId="p2" startId="Der.Out" endId="Lkp.In" name="b"/><path refId="p3" startId="Lkp.Out" endId="Dst.In" name="c"/>')
    (folder / "Load.dtsx").write_text(text)
    return folder, packages.read_packages(spark, str(folder)).cache()


def test_scanned_package_runs(spark, scanned):
    _, rows = scanned
    tables = {"dbo.Orders": spark.createDataFrame([(1,), (2,), (3,)], "Id int"), "dbo.Names": spark.createDataFrame([(1, "one"), (1, "uno"), (2, "two")], "NameId int, Label string")}
    flow = C.package_flow(rows, C.data_flows(rows)[0], tables.__getitem__)
    done = {}
    assert flow.run(lambda name, df: done.update({name: sorted(map(tuple, df.collect()))})) == ["dw.Fact"]
    assert done["dw.Fact"] == [(2, "one"), (4, "two"), (6, None)] and not flow.warnings


def test_convert_to_all_targets(scanned, tmp_path):
    folder, rows = scanned
    for target in C.TARGETS:
        made = C.convert(rows, target)
        assert len(made) > 1 and made["VALIDATION.md"].endswith("pass.\n"), (target, made["VALIDATION.md"])
    assert "LEFT JOIN" in "".join(C.convert(rows, "dbt").values()) and "read_sql" in "".join(C.convert(rows, "pandas").values())
    with pytest.raises(ValueError):
        C.convert(rows, "cobol")
    assert cli.main(["convert", str(folder), "dbt", str(tmp_path / "w.zip")]) == 0 and cli.main(["convert", str(folder), "cobol", "x"]) == 2
    with zipfile.ZipFile(tmp_path / "w.zip") as z:
        assert {"packages/Load.dtsx", ".env", "dbt_project.yml"} <= set(z.namelist())
    real, example = C.env_pair({"Dw": "Server=s;Database=d;Password=secret"})
    assert "DW_SERVER=s" in real and "secret" not in real + example


def test_scan_with_enrichment(spark, scanned):
    folder, rows = scanned
    bodies = spark.createDataFrame([("dbo", "load_it", "INSERT INTO dw.X (q) SELECT a FROM stg.Y")], "schema_name string, name string, body string")
    more = rows.union(rows.where("kind = 'component'").limit(1).select("kind", "package_id", L.F.lit("c9").alias("id"), "name", "type", "parent_id", L.F.create_map(L.F.lit("sql"), L.F.lit("EXEC dbo.load_it"), L.F.lit("connection"), L.F.lit("{C}"))))
    maps = {(m["operation_type"], m["source_table"], m["target_table"], m["target_database"]) for m in S.enriched_maps(more, bodies).collect()}
    assert ("SQL_PROC_INSERT", "Y", "X", "dw") in maps and any(m[:2] == ("LOOKUP_REF", "Names") for m in maps)
    assert S.scan(spark, str(folder)).count() == packages.column_maps(rows).count() + 1


def test_start_package_and_server(scanned):
    assert packages.start_packages(["Load.dtsx", "a/Other.dtsx"], "C:\\etl\\LOAD.dtsx") == ["Load.dtsx"] and packages.start_packages(["a/Other.dtsx"], "other") == ["a/Other.dtsx"]
    assert connections.reachable("Database=x") == (False, "no server") and connections.reachable("Server=127.0.0.1,1", 0.2)[0] is False


def test_cypher_of_a_whole_graph(spark):
    schema = ", ".join(f"{c} string" for c in L.MAP)
    maps = spark.createDataFrame([("p", "t1", "s", "A", "x", "s", "B", "y", "INSERT")], schema)
    parts = spark.createDataFrame([("c1", "t1", "it's", "Lookup"), ("c2", "t1", "n", "Sort")], "component_id string, task_id string, name string, type string")
    order, flows = spark.createDataFrame([("t1", "t2", "Success")], "src string, dst string, value string"), spark.createDataFrame([("c1", "c2")], "src string, dst string")
    lines = [r["line"] for r in exports.cypher(maps, parts, order, flows).collect()]
    assert "MATCH (a:Task {id: 't1'}), (b:Task {id: 't2'}) MERGE (a)-[:PRECEDES {on: 'Success'}]->(b);" in lines
    assert "MATCH (a:Component {id: 'c1'}), (b:Component {id: 'c2'}) MERGE (a)-[:FLOWS_TO]->(b);" in lines
    assert any("name: 'it\\'s'" in x and "BELONGS_TO" in x for x in lines) and len(lines) == 3 + 1 + 1 + 1 + 2 + 1 + 1


def test_lookup_keys():
    keys = lambda a, b, **k: R.lookup_keys(a, b, **k)
    assert keys(["a", "k"], ["x", "k2"], operations=["LOOKUP_JOIN:A=X"]) == ({"a": "x"}, "metadata")
    assert keys(["Id", "n"], ["ID", "v"]) == ({"Id": "ID"}, "common") and keys(["OrderDate"], ["FullDate"]) == ({"OrderDate": "FullDate"}, "date")
    assert keys(["g", "city"], ["City"], earlier={"city": "l1"}) == ({"city": "City"}, "chained")
    assert keys(["o_orderkey", "n_regionkey"], ["r_regionkey"]) == ({"n_regionkey": "r_regionkey"}, "suffix") and keys(["a"], ["b"]) == ({}, "none")
    assert R.supplier("Label", ["id"], {"l1": ["label"], "l2": ["LABEL"]}) == "l2" and R.supplier("id", ["Id"], {"l": ["id"]}) == ""


def test_saved_graph_and_settings(spark, tmp_path):
    maps = spark.createDataFrame([("p", "a"), ("p", 'b"'), ("p", "a"), (None, "c")], "package_id string, target_table string")
    path = str(tmp_path / "g.json")
    exports.write_lines(reports.graph_json({"packages": maps.select("package_id").distinct(), "tasks": maps.limit(0), "columnMappings": maps}), path)
    assert len(json.loads((tmp_path / "g.json").read_text())["columnMappings"]) == 4
    back = loads.load_graph(spark, path)
    assert sorted(back["columnMappings"].select("package_id", "target_table").collect(), key=str) == sorted(maps.collect(), key=str)
    (tmp_path / "no.json").write_text('{"tasks": []}')
    with pytest.raises(ValueError):
        loads.load_graph(spark, str(tmp_path / "no.json"))
    (tmp_path / "c.json").write_text('{"Variables": {"User::A": 5}, "linkedServers": null}')
    assert loads.load_settings(str(tmp_path / "c.json"))["variables"] == {"User::A": "5"} and loads.load_settings(None)["sqlVariables"] == {}
    assert loads.pairs(" a = 1;b;c=x=y;") == {"a": "1", "c": "x=y"} and loads.connection_lines("Dw=Server=s;Database=d\n\nx") == {"Dw": "Server=s;Database=d"}


def test_sql_texts():
    assert sqltext.format_sql("select a, b from t left join u on t.i = u.i where x = 'from'") == "SELECT a, b\nFROM t\nLEFT JOIN u\n    ON t.i = u.i\nWHERE x = 'from'"
    assert sqltext.format_sql(None) == "" and sqltext.tokens("select 1")[0] == ("name", "select")


def test_small_operators(spark):
    uses = spark.createDataFrame([(f"/p{k % 10}", k) for k in range(40)] + [("/P9", 99)], "path string, used_at int")
    assert [tuple(r) for r in R.recent_projects(uses).collect()][:2] == [("/P9", 99), ("/p8", 38)] and R.recent_projects(uses).count() == 8
    schema = ", ".join(f"{c} string" for c in L.MAP)
    maps = spark.createDataFrame([("p", "t", "", "", "x", "d", "F", "y", "INSERT")], schema).withColumns({"source_component_id": L.F.lit("c1"), "source_component_name": L.F.lit("dbo.Src.a")})
    assert R.suggested_questions(maps).count() == 2
    line = [r["line"] for r in reports.lineage_export(maps).collect()][1]
    assert '"dbo","Src.a","x"' in line and line.count('","') == 17
    empty = maps.limit(0)
    assert reports.diff_markdown(L.graph_diff(empty, empty)).where("line like 'No lineage%'").count() == 1 and R.impact_counters(L.impact(empty, "drop_table", "a")).first()["has_critical"] is False
    assert reports.risk_recommendation(L.risk_scores(maps.withColumn("source_table", L.F.lit("S")))).count() == 2
    found = spark.createDataFrame([("@[User::A] + 1",), ("x",), (None,)], "e string").select(sqltext.references_variable(L.F.col("e"), "user::a")).collect()
    assert [r[0] for r in found] == [True, False, False]
