import pytest

from weftline.functions import etl
from weftline.functions.expressions import Compiler, ExpressionError, substitute
from weftline.plans import dataflow as D
from weftline.sinks import exports
from weftline.sources import connections, packages, tsql
from weftline.streaming import landing

PACKAGE = """<?xml version="1.0"?>
<DTS:Executable xmlns:DTS="www.microsoft.com/SqlServer/Dts" xmlns:SQLTask="www.microsoft.com/sqlserver/dts/tasks/sqltask" DTS:DTSID="{P}" DTS:ObjectName="Load" DTS:refId="Package">
 <DTS:ConnectionManagers><DTS:ConnectionManager DTS:ObjectName="Dw" DTS:DTSID="{C}" DTS:CreationName="OLEDB"><DTS:ObjectData><DTS:ConnectionManager DTS:ConnectionString="Data Source=srv;Initial Catalog=dw;Password=pw;"/></DTS:ObjectData></DTS:ConnectionManager></DTS:ConnectionManagers>
 <DTS:Variables><DTS:Variable DTS:Namespace="User" DTS:ObjectName="Q"><DTS:VariableValue>INSERT INTO a.T (x) SELECT y FROM a.S</DTS:VariableValue></DTS:Variable></DTS:Variables>
 <DTS:Executables>
  <DTS:Executable DTS:refId="Package\\Run" DTS:ObjectName="Run" DTS:ExecutableType="Microsoft.ExecuteSQLTask"><DTS:ObjectData><SQLTask:SqlTaskData SQLTask:Connection="{C}" SQLTask:SqlStmtSourceType="Variable" SQLTask:SqlStatementSource="User::Q"><SQLTask:ParameterBinding SQLTask:ParameterName="0" SQLTask:DtsVariableName="User::Q" SQLTask:ParameterDirection="Input"/></SQLTask:SqlTaskData></DTS:ObjectData></DTS:Executable>
  <DTS:Executable DTS:refId="Package\\Seq" DTS:ObjectName="Seq" DTS:ExecutableType="STOCK:SEQUENCE"><DTS:Executables>
   <DTS:Executable DTS:refId="Package\\Seq\\Flow" DTS:ObjectName="Flow" DTS:ExecutableType="Microsoft.Pipeline"><DTS:ObjectData><pipeline>
    <components>
     <component refId="Package\\Seq\\Flow\\Src" name="Src" componentClassID="Microsoft.OLEDBSource"><properties><property name="OpenRowset">[dbo].[Orders]</property></properties><outputs><output refId="Src.Out"><outputColumns><outputColumn lineageId="L1" name="Id"/></outputColumns></output></outputs></component>
     <component refId="Package\\Seq\\Flow\\Der" name="Der" componentClassID="Microsoft.DerivedColumn"><inputs><input refId="Der.In"><inputColumns><inputColumn lineageId="L1" cachedName="Id"/></inputColumns></input></inputs><outputs><output refId="Der.Out"><outputColumns><outputColumn lineageId="L2" name="Twice"><properties><property name="FriendlyExpression">[Id] * 2</property></properties></outputColumn></outputColumns></output></outputs></component>
     <component refId="Package\\Seq\\Flow\\Dst" name="Dst" componentClassID="Microsoft.OLEDBDestination"><properties><property name="OpenRowset">dw.Fact</property></properties><inputs><input refId="Dst.In"><inputColumns><inputColumn lineageId="L2" externalMetadataColumnId="Dst.In.ExternalColumns[Doubled]"/></inputColumns></input></inputs></component>
    </components><paths><path refId="p1" startId="Src.Out" endId="Der.In" name="a"/><path refId="p2" startId="Der.Out" endId="Dst.In" name="b"/></paths></pipeline></DTS:ObjectData></DTS:Executable>
  </DTS:Executables></DTS:Executable>
  <DTS:Executable DTS:refId="Package\\Call" DTS:ObjectName="Call" DTS:ExecutableType="Microsoft.ExecutePackageTask"><DTS:ObjectData><ExecutePackageTask><PackageName>Child.dtsx</PackageName></ExecutePackageTask></DTS:ObjectData></DTS:Executable>
 </DTS:Executables>
 <DTS:PrecedenceConstraints><DTS:PrecedenceConstraint DTS:From="Package\\Run" DTS:To="Package\\Seq" DTS:Value="1"/></DTS:PrecedenceConstraints>
</DTS:Executable>"""


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    folder = tmp_path_factory.mktemp("project")
    (folder / "Load.dtsx").write_text(PACKAGE)
    (folder / "Bad.dtsx").write_text("<no xml")
    (folder / "P.dtproj").write_text('<Project xmlns:SSIS="x"><SSIS:Packages><SSIS:Package SSIS:Name="Load.dtsx"/><SSIS:Package SSIS:Name="Gone.dtsx"/></SSIS:Packages></Project>')
    (folder / "Stage.conmgr").write_text('<DTS:ConnectionManager xmlns:DTS="www.microsoft.com/SqlServer/Dts" DTS:ObjectName="Stage" DTS:DTSID="{S}"><DTS:ObjectData><DTS:ConnectionManager DTS:ConnectionString="Server=s1;Database=stage"/></DTS:ObjectData></DTS:ConnectionManager>')
    return folder


def test_packages(spark, project):
    rows = packages.read_packages(spark, str(project)).cache()
    kinds = {r["kind"]: r["n"] for r in rows.groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds == {"package": 1, "variable": 1, "connection": 1, "task": 3, "container": 1, "component": 4, "map": 4, "data_flow_edge": 2, "execution_edge": 2, "warning": 1}
    maps = {(m["operation_type"], m["source_table"] or m["source_component_name"], m["source_column"], m["target_table"] or m["target_component_name"], m["target_column"]) for m in packages.column_maps(rows).collect()}
    assert maps == {("INSERT", "S", "y", "T", "x"), ("Derived Column", "Orders", "Id", "Der", "Id"), ("DERIVED_COLUMN", "Der", "Id", "Der", "Twice"), ("OLE DB Destination", "Der", "Twice", "Fact", "Doubled")}
    assert len(rows.where("kind = 'package'").first()["fields"]["file_hash"]) == 64
    assert packages.project_packages(str(project)) == ["Load.dtsx"] and packages.start_packages(["Load.dtsx"], "load") == ["Load.dtsx"]
    (project / "Project.params").write_text('<P xmlns:SSIS="x"><SSIS:Parameter SSIS:Name="Env"><SSIS:Properties><SSIS:Property SSIS:Name="Value">dev</SSIS:Property></SSIS:Properties></SSIS:Parameter></P>')
    assert packages.project_parameters(str(project)) == {"Project::Env": "dev"}
    assert packages.reachable(rows, ["Load.dtsx"]) == (["load", "child"], [])
    with pytest.raises(ValueError):
        packages.start_packages(["Load.dtsx"], "other")


def test_package_stream(spark, project, tmp_path):
    seen = []
    landing.start(spark, str(project), lambda df, n: seen.append(df.where("kind = 'task'").count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 3


def test_connections(project):
    c = connections.Connections({"Live": "Server=live;Database=d"})
    c.scan(str(project))
    assert connections.server_and_database(c.resolve("Project.ConnectionManagers[Stage]")) == ("s1", "stage")
    assert connections.server_and_database(c.resolve("{C}")) == ("srv", "dw") and c.resolve("live") == "Server=live;Database=d"
    assert c.resolve("Data Source=x") == "Data Source=x" and c.resolve("nothing at all") is None and connections.server_and_database("") == ("", "")


def ops(sql, **k):
    return [(r["operation_type"], r["source_table"], r["source_column"], r["target_table"], r["target_column"]) for r in tsql.parse(sql, **k)]


def test_tsql_statements():
    assert ops("DELETE d FROM dbo.D d JOIN y ON y.i = d.i") == [("DELETE", "D", "", "D", "")]
    assert ops("INSERT INTO y EXEC hr.z") == [("INSERT_EXEC", "z", "*", "y", "*")]
    assert ops("WITH c AS (SELECT a FROM t) INSERT INTO z (q) SELECT a FROM c") == [("CTE", "t", "a", "c", "a"), ("INSERT", "c", "a", "z", "q")]
    assert ops("SELECT a INTO n FROM O, C, I") == [("SELECTINTO", "O | C | I", "a", "n", "a")]
    assert ops("UPDATE t SET v = 1 FROM T t") == []
    assert ops("DECLARE @t varchar(9) = 'src'; DECLARE @s varchar(99) = 'SELECT * INTO tgt FROM ' + @t; EXEC(@s)") == [("SELECTINTO", "src", "*", "tgt", "*")]
    assert ops("EXEC('SELECT * INTO tgt FROM ' + @t)")[0][1] == "DUMMY"
    assert ops("SELECT ItemId INTO x FROM OPENROWSET('p', 'c', 'SELECT ItemId FROM Items')") == [("SELECTINTO", "Items", "ItemId", "x", "ItemId")]
    merge = ops("MERGE dw.P AS T USING dbo.S AS S ON T.Id = S.Id WHEN MATCHED THEN UPDATE SET T.N = S.N, T.A = GETDATE() WHEN NOT MATCHED THEN INSERT (Id, N, A) VALUES (S.Id, S.N, 'x');")
    assert merge == [("MERGE-UPDATE", "S", "N", "P", "N"), ("MERGE-INSERT", "S", "Id", "P", "Id"), ("MERGE-INSERT", "S", "N", "P", "N")]
    assert ops("") == [] and ops(None) == [] and ops("garbage ((( '") == []
    assert ops("/* a /* nested */ b */ SELECT 1 -- INSERT INTO x SELECT y FROM z") == [("SELECT", "", "", "", "")]
    four = tsql.parse("INSERT INTO t SELECT a FROM [L].[Db].[sc].[T 1]")[0]
    assert (four["source_server"], four["source_database"], four["source_schema"], four["source_table"]) == ("L", "Db", "sc", "T 1")


def test_tsql_small_parts(spark):
    assert tsql.positional("SELECT '?' , ? -- ?") == "SELECT '?' , @P0 -- ?"
    assert tsql.procedure_reference("[staging].[usp_Foo]") == ("staging", "usp_Foo") and tsql.procedure_reference("EXEC @r = dbo.x") == ("dbo", "x")
    assert tsql.procedure_reference("bare") == ("dbo", "bare") and tsql.procedure_reference(" ") is None and tsql.procedure_reference("SELECT 1") is None
    rows = spark.createDataFrame([(1, "INSERT INTO a SELECT b FROM c"), (2, None)], "id long, sql string")
    assert [(r["id"], r["target_column"]) for r in tsql.lineage_records(rows, ["id"], "sql").collect()] == [(1, "b")]


def test_expressions(spark):
    df = spark.createDataFrame([(3, " ab ", None, True), (None, "x", "y", False)], "n int, s string, t string, f boolean")
    run = lambda e, **k: [r[0] for r in df.select(Compiler(df.schema, {"User::V": 5}, **k).compile(e)).collect()]
    assert run('[n] > 2 ? "big" : ([f] ? "yes" : "no")') == ["big", "no"]
    assert run("!ISNULL(t) && [n] == 1 || [f]") == [True, None]
    assert run('TRIM(s) + "-" + (DT_WSTR, 2)(n + 10)') == ["ab-13", None]
    assert run("(DT_I4)s") == [None, None] and run("(DT_I4)s", parity=True) == [" ab ", "x"]
    assert run('FINDSTRING("a,b,c", ",", 2)') == [4, 4] and run("@[User::V] * 2 % 3") == [1, 1]
    assert run("REPLACENULL(t, \"none\")") == ["none", "y"] and run("NULL(DT_I4)") == [None, None] and run("-n - 1") == [-4, None]
    assert run('DATEDIFF("day", (DT_DBDATE)"2024-01-01", (DT_DBDATE)"2024-02-01")') == [31, 31] and run('YEAR(DATEADD("month", 2, (DT_DBDATE)"2023-11-05"))') == [2024, 2024]
    for bad in ("[zzz]", "1 +", "FOO(1)", "(1", '"open'):
        with pytest.raises(ExpressionError):
            run(bad)
    assert substitute('"a+b" + @[User::X] + "c"', {"User::X": "-"}) == "a+b-c" and substitute("@[User::Y]", {}) == "@[User::Y]"


def test_flow_errors_and_lookups(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    ref = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z")], "k int, v string")
    assert sorted(map(str, D.lookup(rows, ref, {"k": "k"}, {"v": "v"}).collect())) == ["Row(k=1, v='a')", "Row(k=2, v=None)", "Row(k=None, v=None)"]
    assert D.lookup(rows, ref, {"k": "k"}, {"v": "v"}, "drop").count() == 1 and D.lookup(rows, ref, {"k": "k"}, {}, "only").count() == 2
    with pytest.raises(D.FlowError):
        D.lookup(rows, ref, {}, {})
    flow = D.Flow([{"id": "a", "type": "Sort", "by": [("k", True)]}, {"id": "b", "type": "Sort", "by": [("k", True)]}], [("a", "b"), ("b", "a")], lambda n: rows)
    with pytest.raises(D.FlowError):
        flow.output("a")


def test_exports(spark, tmp_path):
    m = spark.createDataFrame([("p", "t", "s", "A", "x'y", "s", "B", "z", "SQL_PROC_INSERT"), ("p", "t", "s", "A", "*", "s", "B", "*", "INSERT")], "package_id string, task_id string, source_schema string, source_table string, source_column string, target_schema string, target_table string, target_column string, operation_type string")
    assert any("x\\'y" in r["line"] for r in exports.cypher(m).collect())
    assert sum("-->" in r["line"] for r in exports.mermaid(m).collect()) == 1
    event = [r["line"] for r in exports.openlineage(m).collect()]
    assert len(event) == 1 and '"COMPLETE"' in event[0]
    assert exports.write_lines(exports.lineage_csv(m.select("package_id", "source_column")), str(tmp_path / "a.csv")) == 3
    assert (tmp_path / "a.csv").read_text().splitlines()[0] == '"package_id","source_column"'
    assert exports.write_lines(exports.html_report("R", {"Maps": m}), str(tmp_path / "a.html")) == 5
    assert exports.write_lines(exports.yaml_lines("maps", m.select("task_id", "source_column")), str(tmp_path / "a.yaml")) == 3
    assert '    source_column: "x\'y"' in (tmp_path / "a.yaml").read_text()
    assert len(exports.workbook({"Maps": m, "Tasks": m.select("task_id")}, str(tmp_path))) == 2
    exports.write_lines(exports.markdown("R", {"Maps": m}), str(tmp_path / "a.md"))
    assert (tmp_path / "a.md").read_text().startswith("# R\n\n## Maps")
    assert "columns:" in "".join(r["line"] for r in exports.contract_yaml(spark.createDataFrame([("t", "c")], "table_name string, column_name string")).collect())


def test_redaction_and_labels(spark):
    s = "Data Source=a;Password=secret;PWD = x;User=u"
    assert etl.redact_text(s) == "Data Source=a;Password=***REDACTED***;PWD = ***REDACTED***;User=u" and etl.redact_text(etl.redact_text(s)) == etl.redact_text(s)
    df = spark.createDataFrame([("dw.Simpanan_Tanggal_X",), ("Anggota",)], "n string")
    assert [r[0] for r in df.select(etl.translate(df["n"], etl.load_glossary())).collect()] == ["savings date X", "member"]
