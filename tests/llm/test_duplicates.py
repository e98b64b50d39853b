import random

from weftline.llm import duplicates as D
from weftline.llm import queries


def brute(rows):
    first, out = {}, set()
    for kind, text, own in sorted((r for r in rows if None not in r), key=lambda r: r[2]):
        head = first.setdefault((kind, text), own)
        if head != own:
            out.add((kind, head, own))
    return out


def test_runs_over_partition_edges_equal_brute_force(spark):
    pick = random.Random(1)
    hot = [("m", "hot", k) for k in range(3000)]
    rows = hot + [(pick.choice("me"), pick.choice(["", "a", "b", "long" * 500, None, "ü"]) if pick.random() < 0.3 else f"t{pick.randrange(2000)}", 5000 + k) for k in range(3000)] + [(None, "x", 1), ("m", "x", None)]
    pick.shuffle(rows)
    df = spark.createDataFrame([(*r, "head") for r in rows], "kind string, text string, id long, head string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {tuple(r) for r in D.copies(df).collect()} == brute(rows)
        sizes = {(r["kind"], r["head"]): r["n_copies"] for r in D.groups(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sizes["m", 0] == 3000 and sum(sizes.values()) == sum(None not in r for r in rows)


def test_no_rows(spark):
    assert D.copies(spark.createDataFrame([], "kind string, text string, id long")).count() == 0


def test_canonical_records(spark):
    maps = [(1, "dbo", "A_1 | [B]", "Col x", "T"), (2, "[DBO]", "b|a1", "colX", "t​"), (3, None, "é", "c", "t"), (4, " ", "e", "c", "t"), (5, "", "É", "C", "T"), (6, "d", "t", "*", "t"), (7, "d", "t", None, "t")]
    df = spark.createDataFrame(maps, "map_id long, source_schema string, source_table string, source_column_name string, target_table string")
    exports = [(1, '{"SourceSchema":"S", "SourceTable":"a b","SourceColumnName":"C","TargetTable":"t"}'), (2, "TargetTable = T ;SourceColumnName=c; SourceTable=AB;SourceSchema = s"), (3, "{broken"), (4, None), (5, "")]
    ex = spark.createDataFrame(exports, "export_id long, payload string")
    assert {tuple(r) for r in D.copies(D.map_records(df, ex)).collect()} == {("map", 1, 2), ("map", 3, 5), ("export", 1, 2)}


def test_queries_match_sql(spark, data):
    from compare import compare

    for name in ("p1_found", "p1_groups"):
        good, said = compare(spark, data, queries.QUERIES[name], queries.ORACLE[name])
        assert good, said
