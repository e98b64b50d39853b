"""Queries that run data flows over the relational tables, with the SQL they match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.expressions import Compiler
from weftline.plans import dataflow as D
from weftline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _flow(components: list[dict], paths: list[tuple], out: str, output: str = "", variables: dict | None = None) -> Query:
    return lambda spark, sf_dir: D.Flow(components, paths, lambda name: table(spark, sf_dir, name), variables).output(out, output)


ORDERS = {"id": "orders", "type": "OLE DB Source", "table": "orders"}
CUSTOMER = {"id": "customer", "type": "Lookup", "reference": "customer", "keys": {"o_custkey": "c_custkey"}, "columns": {"c_name": "c_name", "c_nationkey": "c_nationkey"}}
NATION = {"id": "nation", "type": "Lookup", "reference": "nation", "keys": {"c_nationkey": "n_nationkey"}, "columns": {"n_name": "n_name", "n_regionkey": "n_regionkey"}}
REGION = {"id": "region", "type": "Lookup", "reference": "region", "keys": {"n_regionkey": "r_regionkey"}, "columns": {"r_name": "r_name"}}


def _pick(query: Query, *columns: str) -> Query:
    return lambda spark, sf_dir: query(spark, sf_dir).select(*columns)


def _casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    compiler = Compiler(p.schema)
    casts = {"as_text": "(DT_WSTR, 4)[p_name]", "as_int": "(DT_I4)(DT_WSTR, 10)[p_size]", "as_decimal": "(DT_NUMERIC, 12, 2)[p_retailprice]", "as_bool": "(DT_BOOL)([p_size] % 2)", "bad_int": "(DT_I4)[p_brand]", "nested": "(DT_I8)((DT_WSTR, 20)((DT_I4)[p_size] + 1))"}
    out = p.select("p_partkey", *[compiler.compile(e).alias(n) for n, e in casts.items()])
    return out.withColumn("as_decimal", F.col("as_decimal").cast("double"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    compiler = Compiler(c.schema, {"User::Prefix": "C-", "System::Batch": 7})
    made = {
        "joined": '@[User::Prefix] + UPPER(TRIM([c_mktsegment])) + "/" + (DT_WSTR, 10)[c_nationkey]',
        "third": 'FINDSTRING([c_name], "0", 3)', "part": 'TOKEN([c_name], "#", 2)', "piece": "SUBSTRING([c_name], 1, 4)", "swapped": 'REPLACE([c_mktsegment], "A", "*")',
        "size": "LEN([c_mktsegment]) * 2 + @[System::Batch]", "filled": 'REPLACENULL([c_mktsegment], "none")', "whole": "(DT_I8)FLOOR([c_acctbal])", "missing": 'ISNULL([c_mktsegment]) ? 1 : 0',
    }
    return c.select("c_custkey", *[compiler.compile(e).alias(n) for n, e in made.items()])


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as target; as source those with orders, and as many that the target doesn't have."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    orders = table(spark, sf_dir, "orders")
    bought = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("c_mktsegment"), F.max("o_totalprice").alias("c_acctbal"))
    others = orders.groupBy((-F.col("o_custkey")).alias("c_custkey")).agg(F.min("o_orderstatus").alias("c_mktsegment"), F.min("o_totalprice").alias("c_acctbal"))
    new = bought.union(others)
    return D.merge_upsert(old, new, ["c_custkey"], ["c_mktsegment", "c_acctbal"])


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return D.delete_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, {"o_custkey": "c_custkey"})


def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return D.update_from(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), other, {"o_custkey": "c_custkey"}, {"o_orderstatus": "c_mktsegment"})


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pk_order"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"))
    return D.expectations(o, {"order_status": ["O", "F"]})


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames):
        for frame in frames:
            yield frame.assign(doubled=frame["l_quantity"] * 2)[["l_orderkey", "l_linenumber", "doubled"]]

    flow = D.Flow(
        [{"id": "s", "type": "Source", "table": "lineitem"}, {"id": "x", "type": "Script Component", "function": run, "schema": "l_orderkey long, l_linenumber int, doubled double"}, {"id": "a", "type": "Aggregate", "group": ["l_linenumber"], "aggregates": {"total": ("sum", "doubled"), "n": ("count", "*")}}],
        [("s", "x"), ("x", "a")], lambda name: table(spark, sf_dir, name),
    )
    return flow.output("a")


def _unkeyed(lookup: dict, **more: object) -> dict:
    return {k: v for k, v in lookup.items() if k != "keys"} | more


_SPLIT = {"id": "split", "type": "Conditional Split", "cases": {"large": "[o_totalprice] > 200000", "open": '[o_orderstatus] == "O"'}, "default": "rest"}
QUERIES: dict[str, Query] = {
    "dataflow_source_projection": _flow([ORDERS, {"id": "d", "type": "OLE DB Destination", "table": "t", "mappings": [{"target": "Id", "source": "o_orderkey"}, {"target": "Price", "source": "o_totalprice"}, {"target": "price", "source": "o_custkey", "expression": "[o_totalprice] * 2"}]}], [("orders", "d")], "d"),
    "dataflow_lookup_customer": _pick(_flow([ORDERS, CUSTOMER], [("orders", "customer")], "customer"), "o_orderkey", "c_name"),
    "dataflow_lookup_chained": _pick(_flow([ORDERS, CUSTOMER, NATION, REGION], [("orders", "customer"), ("customer", "nation"), ("nation", "region")], "region"), "o_orderkey", "c_name", "n_name", "r_name"),
    "dataflow_lookup_resolved_keys": _pick(_flow([ORDERS, _unkeyed(CUSTOMER, operations=["LOOKUP_JOIN:o_custkey=c_custkey"]), {"id": "rename", "type": "Derived Column", "columns": {"n_nationkey": "[c_nationkey]"}}, _unkeyed(NATION), _unkeyed(REGION), {"id": "none", "type": "Lookup", "reference": "events", "columns": {"nothing": "event_type"}}], [("orders", "customer"), ("customer", "rename"), ("rename", "nation"), ("nation", "region"), ("region", "none")], "none"), "o_orderkey", "c_name", "n_name", "r_name", "nothing"),
    "dataflow_lookup_nomatch": _pick(_flow([{"id": "s", "type": "Source", "table": "customer"}, {"id": "l", "type": "Lookup", "reference": "orders", "keys": {"c_custkey": "o_custkey"}, "no_match": "only"}], [("s", "l")], "l"), "c_custkey"),
    "dataflow_lookup_first_match": _pick(_flow([{"id": "s", "type": "Source", "table": "customer"}, {"id": "l", "type": "Lookup", "reference": "orders", "keys": {"c_custkey": "o_custkey"}, "columns": {"first_order": "o_orderkey"}}], [("s", "l")], "l"), "c_custkey", "first_order"),
    "dataflow_derived_column": _pick(_flow([{"id": "s", "type": "Source", "table": "lineitem"}, {"id": "d", "type": "Derived Column", "columns": {"net": "[l_extendedprice] * (1 - [l_discount])", "flagged": '[l_returnflag] == "R" && [l_quantity] >= 10 ? 1 : 0', "code": '[l_returnflag] + "-" + [l_linestatus]'}}, {"id": "a", "type": "Aggregate", "group": ["code", "flagged"], "aggregates": {"n": ("count", "*"), "net": ("sum", "net")}}], [("s", "d"), ("d", "a")], "a"), "code", "flagged", "n", "net"),
    "dataflow_nested_ternary": _pick(_flow([{"id": "s", "type": "Source", "table": "orders"}, {"id": "d", "type": "Derived Column", "columns": {"band": '([o_totalprice] > 300000 ? "A" : ([o_totalprice] > 100000 ? "B" : "C")) + ([o_orderstatus] != "O" || ISNULL([o_orderpriority]) ? "x" : "y")'}}], [("s", "d")], "d"), "o_orderkey", "band"),
    "dataflow_conditional_split": _pick(_flow([ORDERS, _SPLIT], [("orders", "split")], "split", "open"), "o_orderkey"),
    "dataflow_split_default": _pick(_flow([ORDERS, _SPLIT], [("orders", "split")], "split", "rest"), "o_orderkey"),
    "dataflow_union_all": _pick(_flow([ORDERS, _SPLIT, {"id": "u", "type": "Union All"}], [("orders", "split"), ("split", "u", "large"), ("split", "u", "rest")], "u"), "o_orderkey", "o_totalprice"),
    "dataflow_aggregate": _flow([{"id": "s", "type": "Source", "table": "lineitem"}, {"id": "a", "type": "Aggregate", "group": ["l_returnflag", "l_linestatus"], "aggregates": {"n": ("count", "*"), "total": ("sum", "l_quantity"), "mean": ("average", "l_discount"), "least": ("minimum", "l_tax"), "most": ("maximum", "l_extendedprice"), "suppliers": ("count distinct", "l_suppkey")}}], [("s", "a")], "a"),
    "dataflow_sort_dedupe": _pick(_flow([{"id": "s", "type": "Source", "table": "orders"}, {"id": "o", "type": "Sort", "by": [("o_custkey", True)], "remove_duplicates": True}], [("s", "o")], "o"), "o_custkey", "o_orderkey"),
    "dataflow_script": _script,
    "dataflow_merge_upsert": _merge,
    "dataflow_delete_join": _delete,
    "dataflow_update_from": _update,
    "dq_expectations": _quality,
    "type_cast_matrix": _casts,
    "expression_functions": _functions,
}

ORACLE: dict[str, str] = {
    "dataflow_source_projection": "SELECT o_orderkey AS \"Id\", o_totalprice * 2 AS price FROM orders",
    "dataflow_lookup_customer": "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "dataflow_lookup_chained": "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
    "dataflow_lookup_resolved_keys": "SELECT o_orderkey, c_name, n_name, r_name, CAST(NULL AS VARCHAR) AS nothing FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
    "dataflow_lookup_nomatch": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "dataflow_lookup_first_match": "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer",
    "dataflow_derived_column": "SELECT l_returnflag || '-' || l_linestatus AS code, CASE WHEN l_returnflag = 'R' AND l_quantity >= 10 THEN 1 ELSE 0 END AS flagged, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY 1, 2",
    "dataflow_nested_ternary": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'A' WHEN o_totalprice > 100000 THEN 'B' ELSE 'C' END || CASE WHEN o_orderstatus <> 'O' OR o_orderpriority IS NULL THEN 'x' ELSE 'y' END AS band FROM orders",
    "dataflow_conditional_split": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT o_totalprice > 200000",
    "dataflow_split_default": "SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 200000 AND o_orderstatus <> 'O'",
    "dataflow_union_all": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 OR o_orderstatus <> 'O'",
    "dataflow_aggregate": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS total, avg(l_discount) AS mean, min(l_tax) AS least, max(l_extendedprice) AS most, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2",
    "dataflow_sort_dedupe": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 ORDER BY 1",
    "dataflow_script": "SELECT l_linenumber, sum(l_quantity * 2) AS total, count(*) AS n FROM lineitem GROUP BY 1",
    "dataflow_merge_upsert": "WITH s AS (SELECT o_custkey AS k, min(o_orderpriority) AS m, max(o_totalprice) AS b FROM orders GROUP BY 1 UNION ALL SELECT -o_custkey, min(o_orderstatus), min(o_totalprice) FROM orders GROUP BY 1) SELECT coalesce(k, c_custkey) AS c_custkey, CASE WHEN k IS NULL THEN c_mktsegment ELSE m END AS c_mktsegment, CASE WHEN k IS NULL THEN c_acctbal ELSE b END AS c_acctbal FROM customer FULL JOIN s ON k = c_custkey",
    "dataflow_delete_join": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')",
    "dataflow_update_from": "SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN o_orderstatus ELSE c_mktsegment END AS o_orderstatus FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0",
    "dq_expectations": "WITH o AS (SELECT * FROM orders) SELECT 'row_count' AS rule, '*' AS column_name, CAST(CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END AS BIGINT) AS failed, count(*) >= 1 AS passed FROM o UNION ALL SELECT 'unique', 'pk_order', count(o_orderkey) - count(DISTINCT o_orderkey), count(o_orderkey) = count(DISTINCT o_orderkey) FROM o UNION ALL SELECT 'not_null', 'customer_id', count(*) FILTER (o_custkey IS NULL), count(*) FILTER (o_custkey IS NULL) = 0 FROM o UNION ALL SELECT 'in_set', 'order_status', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')), count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) = 0 FROM o",
    "type_cast_matrix": "SELECT p_partkey, substr(p_name, 1, 4) AS as_text, CAST(p_size AS INTEGER) AS as_int, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS DOUBLE) AS as_decimal, p_size % 2 = 1 AS as_bool, TRY_CAST(p_brand AS INTEGER) AS bad_int, CAST(p_size + 1 AS BIGINT) AS nested FROM part",
    "expression_functions": "WITH c AS (SELECT *, list_filter(range(1, length(c_name) + 1), lambda i: substr(c_name, i, 1) = '0') AS zeros FROM customer) SELECT c_custkey, 'C-' || upper(trim(c_mktsegment)) || '/' || c_nationkey AS joined, CAST(coalesce(zeros[3], 0) AS INTEGER) AS third, split_part(c_name, '#', 2) AS part, substr(c_name, 1, 4) AS piece, replace(c_mktsegment, 'A', '*') AS swapped, CAST(length(c_mktsegment) * 2 + 7 AS INTEGER) AS size, coalesce(c_mktsegment, 'none') AS filled, CAST(floor(c_acctbal) AS BIGINT) AS whole, CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END AS missing FROM c",
}
