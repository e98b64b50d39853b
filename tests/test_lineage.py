from weftline.operators import lineage as L
from weftline.operators import questions as Q
from weftline.operators import schedule as S

SCHEMA = ", ".join(f"{c} string" for c in L.MAP)


def maps(spark, *edges):
    rows = []
    for k, (a, b) in enumerate(edges):
        (st, sc), (tt, tc) = a.rsplit(".", 1), b.rsplit(".", 1)
        s, t = st.split("."), tt.split(".")
        rows.append((f"p{k % 2}", f"t{k}", s[0] if len(s) > 1 else "", s[-1], sc, t[0] if len(t) > 1 else "", t[-1], tc, "INSERT"))
    return spark.createDataFrame(rows, SCHEMA)


def hops(found):
    return {(r["source_node"][2:] + "." + r["source_column"], r["target_node"][2:] + "." + r["target_column"]) for r in found.collect()}


def test_trace_both_is_up_and_down(spark):
    m = maps(spark, ("s.A.x", "s.B.y"), ("s.B.y", "s.C.z"), ("s.C.z", "s.D.w"), ("q.A.x", "q.B.x"))
    up, down, both = (hops(L.trace(m, "s.b", "Y", d)) for d in ("up", "down", "both"))
    assert up == {("s.a.x", "s.b.y")} and down == {("s.b.y", "s.c.z"), ("s.c.z", "s.d.w")} and both == up | down
    ranks = {r["source_node"]: r["step_rank"] for r in L.trace(m, "s.b", "y", "both").collect()}
    assert ranks == {"t:s.a": 0, "t:s.b": 1, "t:s.c": 2}


def test_wildcards_carry_columns_both_ways(spark):
    m = maps(spark, ("s.Tmp.*", "s.Stage.*"), ("s.Stage.amount", "d.Fact.amount"), ("s.Tmp.other", "s.X.other"), ("s.Raw.amount", "s.Tmp.amount"))
    assert hops(L.trace(m, "d.fact", "amount", "up")) == {("s.stage.amount", "d.fact.amount"), ("s.tmp.*", "s.stage.*"), ("s.raw.amount", "s.tmp.amount")}
    assert ("s.tmp.*", "s.stage.*") in hops(L.trace(m, "s.tmp", "amount", "down"))


def test_loops_end(spark):
    m = maps(spark, ("s.A.x", "s.B.x"), ("s.B.x", "s.A.x"))
    assert len(hops(L.trace(m, "s.a", "x", "both"))) == 2
    assert L.mapping_steps(m).count() == 2


def test_steps_of_two_maps_side_by_side(spark):
    m = maps(spark, ("s.A.a", "s.B.a"), ("s.A.b", "s.B.b"), ("s.B.a", "s.C.a"))
    assert sorted(r["step_number"] for r in L.mapping_steps(m).collect()) == [1, 1, 2]


def test_risk_is_within_bounds_and_skips_self_edges(spark):
    m = maps(spark, ("s.A.a", "s.B.a"), ("s.B.a", "s.C.a"), ("s.A.a", "s.C.b"), ("s.C.a", "s.C.a"))
    rows = {r["table_name"]: r for r in L.risk_scores(m).collect()}
    assert all(0 <= r["score"] <= 100 for r in rows.values()) and rows["s.c"]["depth"] == 2 and not rows["s.c"]["is_final_target"]
    assert {r["table_name"]: r["depth"] for r in L.risk_scores(m, self_edges=True).collect()}["s.c"] == 3


def test_diff_with_itself_is_empty(spark):
    m = maps(spark, ("s.A.a", "s.B.a"))
    assert L.graph_diff(m, m).count() == 0
    assert {tuple(r)[:2] for r in L.graph_diff(m, maps(spark, ("s.A.a", "s.D.a"))).collect()} == {("mapping", "added"), ("mapping", "removed")}


def test_empty_maps(spark):
    m = spark.createDataFrame([], SCHEMA)
    assert L.trace(m, "a.b", None, "both").count() == 0 and L.risk_scores(m).count() == 0 and Q.orphans(m).count() == 0
    assert L.impact(m, "drop_table", "a.b").count() == 0 and L.mapping_steps(m).count() == 0


def test_questions():
    assert Q.parse("Where does dw.Fact.Amount come from?").intent == "column_source"
    assert Q.parse("tables with no downstream", strict=True).intent == "orphans"
    assert Q.parse("tables with no downstream").intent == "column_target"
    assert Q.parse("columns most used more than 7 times").threshold == 7
    assert Q.parse("what writes to flow_target_table").entity == "flow_target_table"


def test_impact_transitive(spark):
    m = maps(spark, ("s.A.a", "s.B.a"), ("s.B.a", "s.C.a"), ("s.X.a", "s.Y.a"))
    assert {r["task_id"] for r in L.transitive_impact(m, "s.a", "a").collect()} == {"t0", "t1"}


def test_critical_path(spark):
    tasks = spark.createDataFrame([("a", "p1", "Data Flow Task", ""), ("b", "p2", "Microsoft.Pipeline", ""), ("c", "p3", "Execute SQL Task", "a procedure")], "task_id string, package_id string, type string, description string")
    parts = spark.createDataFrame([("b", "p2", "Sort")], "task_id string, package_id string, type string")
    timed = S.durations(tasks, parts)
    got = {r["task_id"]: (r["seconds"], r["reason"]) for r in timed.collect()}
    assert got["a"][0] == 45 and got["b"][0] == 105 and got["c"][0] == 70 and got["b"][1].startswith("PERF-001")
    edges = spark.createDataFrame([("a", "b"), ("b", "b"), ("a", "gone")], "src string, dst string")
    path = S.critical_path(timed.select("task_id", "seconds"), edges)
    assert path == {"path": ["a", "b"], "seconds": 150.0, "service_level": 188, "at_risk": False}


def test_sequence():
    assert S.execution_sequence({"1": "b", "2": "a", "3": "c", "4": "d"}, [("1", "3"), ("2", "3"), ("3", "4")]) == {"2": 1, "1": 2, "3": 3, "4": 4}
    assert S.execution_sequence({"1": "x", "2": "y"}, [("1", "2"), ("2", "1")]) == {"1": 1, "2": 2}
