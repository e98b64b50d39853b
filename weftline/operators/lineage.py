"""Lineage graph: nodes, edges, closure, ranks, traces, search and reports over column maps.

A column map says that a target column is filled from a source column. The operators take maps with
the columns of MAP; an empty text is the null marker, names are compared without letter case, and
keys are lower-case texts so that joins and groups are plain equalities.

Many maps share an edge, so every fixpoint starts from distinct edges and joins back to maps once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import graphs
from weftline.session import checkpointed

MAP = ["package_id", "task_id", "source_schema", "source_table", "source_column", "target_schema", "target_table", "target_column", "operation_type"]


def derived_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column maps derived from the lineitem table: six layers of tables, wildcards among them."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("weftline_lineitem")
    return spark.sql(MAPS_SQL.replace("FROM lineitem", "FROM weftline_lineitem").replace("VARCHAR", "STRING"))


#: The same text gives the same rows in Spark and in DuckDB.
MAPS_SQL = """
SELECT * FROM (
SELECT concat('pkg_', CAST(l_suppkey % 12 AS VARCHAR)) AS package_id,
  concat('task_', CAST(l_suppkey % 12 AS VARCHAR), '_', CAST(l_partkey % 6 AS VARCHAR)) AS task_id,
  concat('L', CAST(l_partkey % 6 AS VARCHAR)) AS source_schema,
  concat('t', CAST((l_partkey % 6) * 8 + l_suppkey % 8 AS VARCHAR)) AS source_table,
  CASE WHEN l_linenumber = 7 THEN '*' ELSE concat('c', CAST(l_linenumber % 4 AS VARCHAR)) END AS source_column,
  concat('L', CAST(l_partkey % 6 + 1 AS VARCHAR)) AS target_schema,
  concat('t', CAST((l_partkey % 6 + 1) * 8 + l_orderkey % 8 AS VARCHAR)) AS target_table,
  CASE WHEN l_linenumber = 7 THEN '*' ELSE concat('c', CAST((l_linenumber + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) % 4 AS VARCHAR)) END AS target_column,
  CASE l_returnflag WHEN 'A' THEN 'INSERT' WHEN 'N' THEN 'SQL_PROC_INSERT' ELSE 'DERIVED_COLUMN' END AS operation_type
FROM lineitem
) m WHERE source_column = '*' OR source_table NOT IN ('t16', 't17', 't33', 't35')
"""


def text(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def label(*parts: Column) -> Column:
    """The parts that aren't empty, joined by dots."""
    return F.concat_ws(".", *[F.when(p != "", p) for p in parts])


def node_key(schema: Column, table: Column, component_id: Column | None = None, component_name: Column | None = None, known: Column | None = None) -> Column:
    """A node's key: t: and the table, else c: and a known component's id, else x: and its name.

    Server and database aren't part of it: one schema and table on two servers are one node.
    """
    none = F.lit("")
    cid, cname = (none if component_id is None else component_id), (none if component_name is None else component_name)
    registered = F.lit(False) if known is None else known
    real = F.lower(label(schema, table))
    return (
        F.when(table != "", F.concat(F.lit("t:"), real))
        .when(registered & (cid != ""), F.concat(F.lit("c:"), F.lower(cid)))
        .otherwise(F.concat(F.lit("x:"), F.lower(F.when(cname != "", cname).otherwise(cid))))
    )


def keyed(maps: DataFrame) -> DataFrame:
    """maps with source_node, source_key, target_node and target_key; columns trimmed for the key."""
    side = lambda s: node_key(text(f"{s}_schema"), text(f"{s}_table"), *([text(f"{s}_component_id"), text(f"{s}_component_name")] if f"{s}_component_id" in maps.columns else []))
    column = lambda s: F.lower(F.trim(text(f"{s}_column")))
    return maps.select(
        "*", side("source").alias("source_node"), column("source").alias("source_key"), side("target").alias("target_node"), column("target").alias("target_key")
    )


def _ends(maps: DataFrame, *parts: str) -> DataFrame:
    """The distinct ends of maps as they are written, so that keys are made of few rows."""
    own = [f"{s}_{p}" for s in ("source", "target") for p in ("schema", "table", "component_id", "component_name", *parts) if f"{s}_{p}" in maps.columns]
    rest = [f"{s}_column" for s in ("source", "target") if f"{s}_column" not in own]
    return maps.select(*own).distinct().withColumns({c: F.lit("") for c in rest})


def column_pairs(maps: DataFrame) -> DataFrame:
    """Distinct (source_node, source_key, target_node, target_key): all that graphs need of maps."""
    return keyed(_ends(maps, "column")).select("source_node", "source_key", "target_node", "target_key").distinct()


def column_edges(pairs: DataFrame) -> DataFrame:
    """Edges between columns; pairs with an empty column or equal ends are no edges."""
    return pairs.where("source_key <> '' and target_key <> '' and not (source_node = target_node and source_key = target_key)")


def registry(pairs: DataFrame) -> DataFrame:
    """(node, key) of every column that a map names."""
    return pairs.select(F.col("source_node").alias("node"), F.col("source_key").alias("key")).union(pairs.select("target_node", "target_key")).where("key <> ''").distinct()


def bridges(edges: DataFrame, known: DataFrame, down: bool = True) -> DataFrame:
    """Edges that lead named columns through tables which are copied whole (* to *).

    A named column without an edge of its own in the direction crosses each * to * edge of its
    table and comes out as the same column where that is known, else as *.
    """
    near, far = ("source", "target") if down else ("target", "source")
    own = edges.select(F.col(f"{near}_node").alias("node"), F.col(f"{near}_key").alias("key")).distinct()
    whole = edges.where("source_key = '*' and target_key = '*'").select(F.col(f"{near}_node").alias("node"), F.col(f"{far}_node").alias("far")).distinct()
    crossing = known.where("key <> '*'").join(own, ["node", "key"], "left_anti").join(whole, "node")
    out = known.select(F.col("node").alias("far"), F.col("key"), F.lit(True).alias("there"))
    crossed = crossing.join(out, ["far", "key"], "left").withColumn("key2", F.when(F.col("there"), F.col("key")).otherwise("*"))
    return crossed.select(
        F.col("node").alias(f"{near}_node"), F.col("key").alias(f"{near}_key"), F.col("far").alias(f"{far}_node"), F.col("key2").alias(f"{far}_key")
    ).select("source_node", "source_key", "target_node", "target_key")


def ranks(edges: DataFrame) -> DataFrame:
    """(id, rank): the edges of the longest path to each id of edges (src, dst).

    Edges from an id to itself are skipped; ids on a loop share the rank of the loop.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("weight", F.lit(1.0))
    return graphs.longest_paths(edges, ends).select("id", F.col("start").cast("long").alias("rank"))


_ID = "concat({0}_node, '|', {0}_key)"


def trace(maps: DataFrame, table: str, column: str | None = None, direction: str = "down") -> DataFrame:
    """The edges that lead from (down), to (up) or through (both) a table or one of its columns.

    table is 'schema.table'. Returns source_node, source_column, target_node, target_column and
    step_rank, the longest path of columns to the edge's source within the trace.
    An unknown table or no maps give no rows.
    """
    pairs = checkpointed(column_pairs(maps))
    edges, known = column_edges(pairs), checkpointed(registry(pairs))
    seeds = known.where((F.col("node") == f"t:{table.lower()}") & (F.lit(column is None) | (F.col("key") == (column or "").lower()))).select(F.concat("node", F.lit("|"), "key").alias("id"))
    taken = None
    for down in (True, False) if direction == "both" else (direction == "down",):
        near, far = ("source", "target") if down else ("target", "source")
        bridge = checkpointed(bridges(edges, known, down))
        steps = edges.union(bridge).select(F.expr(_ID.format(near)).alias("src"), F.expr(_ID.format(far)).alias("dst"))
        reached = graphs.reachable(steps, seeds)
        direct = edges.withColumn("id", F.expr(_ID.format(near))).join(reached, "id", "left_semi").drop("id")
        used = bridge.withColumn("id", F.expr(_ID.format(near))).join(reached, "id", "left_semi").select("source_node", F.lit("*").alias("source_key"), "target_node", F.lit("*").alias("target_key"))
        part = direct.union(used)
        taken = part if taken is None else taken.union(part)
    taken = checkpointed(taken.distinct())
    ranked = ranks(taken.select(F.expr(_ID.format("source")).alias("src"), F.expr(_ID.format("target")).alias("dst")))
    return taken.withColumn("id", F.expr(_ID.format("source"))).join(ranked, "id").select(
        "source_node", F.col("source_key").alias("source_column"), "target_node", F.col("target_key").alias("target_column"), F.col("rank").cast("int").alias("step_rank")
    )


def table_edges(maps: DataFrame) -> DataFrame:
    """Distinct (src, dst) of table nodes over all maps, those without columns too."""
    return keyed(_ends(maps)).select(F.col("source_node").alias("src"), F.col("target_node").alias("dst")).where("src <> 'x:' and dst <> 'x:'").distinct()


def mapping_steps(maps: DataFrame) -> DataFrame:
    """maps with step_number: one more than the longest path of tables to the source."""
    ranked = ranks(checkpointed(table_edges(maps))).select(F.col("id").alias("source_node"), (F.col("rank") + 1).alias("step_number"))
    return keyed(maps).join(ranked, "source_node").select(*maps.columns, F.col("step_number").cast("int").alias("step_number"))


def column_lineage_report(maps: DataFrame) -> DataFrame:
    """The reporting rows: distinct maps with labels of both sides, by step, package, task, target."""
    return mapping_steps(maps).select(
        "step_number", "package_id", "task_id", label(text("source_schema"), text("source_table"), text("source_column")).alias("source_label"),
        label(text("target_schema"), text("target_table"), text("target_column")).alias("target_label"), "operation_type",
    ).distinct()


def search(maps: DataFrame, term: str, scope: str = "table", most: int = 50) -> DataFrame:
    """Tables or columns whose label holds term, in order, most of them at most; blank finds all."""
    parts = ("schema", "table") if scope == "table" else ("schema", "table", "column")
    sides = [maps.select(label(*[text(f"{s}_{p}") for p in parts]).alias("display"), text(f"{s}_column").alias("column")) for s in ("source", "target")]
    found = sides[0].union(sides[1]).where((F.col("display") != "") & (F.lit(scope == "table") | (F.col("column") != "")))
    first = found.where(F.lower("display").contains(term.strip().lower())).groupBy(F.lower("display").alias("key")).agg(F.min("display").alias("display"))
    return first.orderBy("key").limit(most).select("display")


def display_names(maps: DataFrame) -> DataFrame:
    """(node, display): for each node the first of its spellings, tables before component names."""
    sides = [maps.select(node_key(text(f"{s}_schema"), text(f"{s}_table")).alias("node"), label(text(f"{s}_schema"), text(f"{s}_table")).alias("display")) for s in ("source", "target")]
    order = Window.partitionBy("node").orderBy((~F.col("display").contains(".")).cast("int"), "display")
    return sides[0].union(sides[1]).distinct().withColumn("n", F.row_number().over(order)).where("n = 1").select("node", "display")


def risk_scores(maps: DataFrame, self_edges: bool = False) -> DataFrame:
    """The risk of each table: fan-out, depth, readers and maps, each up to 25 points.

    Points are the share of the largest value, rounded half to even. level is Critical from 75, High
    from 50, Medium from 25, else Low. With self_edges, maps from a table to itself raise its depth
    up to the number of tables, as they do where the depth is relaxed over all maps.
    """
    src, dst = F.lower(label(text("source_schema"), text("source_table"))), F.lower(label(text("target_schema"), text("target_table")))
    sides = maps.select(F.when(text("source_table") != "", src).alias("src"), F.when(text("target_table") != "", dst).alias("dst"), text("package_id").alias("package_id"))
    counted = sides.groupBy("src", "dst", "package_id").agg(F.count("*").alias("n"))  # far fewer rows than maps
    counted = checkpointed(counted)
    writer = counted.where("dst is not null").select(F.col("dst").alias("table_name"), F.when(F.col("package_id") != "", F.col("package_id")).alias("writer"), "n")
    reader = counted.where("src is not null").select(F.col("src").alias("table_name"), F.when(F.col("package_id") != "", F.col("package_id")).alias("reader"), F.when(F.col("src") != F.col("dst"), F.col("dst")).alias("down"), "n")
    reads = reader.groupBy("table_name").agg(F.count_distinct("reader").alias("reader_packages"), F.count_distinct("down").alias("downstream_tables"), F.sum("n").alias("as_source"))
    writes = writer.groupBy("table_name").agg(F.count_distinct("writer").alias("writer_packages"), F.sum("n").alias("as_target"))
    pairs = counted.where("src is not null and dst is not null").select("src", "dst").distinct()
    depth = ranks(pairs).select(F.col("id").alias("table_name"), F.col("rank").alias("depth"))
    full = reads.join(writes, "table_name", "full").join(depth, "table_name", "left")
    if self_edges:
        loops = pairs.where("src = dst").select(F.col("src").alias("table_name"), F.lit(True).alias("loop"))
        full = full.join(loops, "table_name", "left").withColumn("depth", F.when(F.col("loop"), F.count("*").over(Window.partitionBy())).otherwise(F.col("depth"))).drop("loop")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    numbers = full.select(
        "table_name", zero("downstream_tables").alias("downstream_tables"), zero("writer_packages").alias("writer_packages"), zero("reader_packages").alias("reader_packages"),
        zero("depth").alias("depth"), (zero("as_source") + zero("as_target")).alias("mapping_count"), (F.col("as_source").isNull() & F.col("as_target").isNotNull()).alias("is_final_target"),
    )
    numbers = checkpointed(numbers)
    top = numbers.agg(*[F.max(c).alias(c) for c in ("downstream_tables", "depth", "reader_packages", "mapping_count")]).first()
    points = lambda c: F.when(F.col(c) > 0, F.bround(F.col(c) / F.lit(top[c] or 1) * 25, 0)).otherwise(0).cast("int")
    scored = numbers.withColumns(
        {"fan_out_score": points("downstream_tables"), "depth_score": points("depth"), "shared_score": points("reader_packages"), "mapping_score": points("mapping_count")}
    )
    total = F.expr("fan_out_score + depth_score + shared_score + mapping_score")
    level = F.when(total >= 75, "Critical").when(total >= 50, "High").when(total >= 25, "Medium").otherwise("Low")
    return scored.select(
        "table_name", total.cast("int").alias("score"), level.alias("level"), "fan_out_score", "depth_score", "shared_score", "mapping_score",
        "downstream_tables", "writer_packages", "reader_packages", "depth", "mapping_count", "is_final_target",
    )


def risk_levels(scores: DataFrame) -> DataFrame:
    """(level, n_tables, average_score) of each level that occurs."""
    return scores.groupBy("level").agg(F.count("*").alias("n_tables"), F.avg("score").alias("average_score"))


def matches_table(maps: DataFrame, side: str, table: str) -> Column:
    """Whether a side of a map is the table: by schema and name, or by its name alone."""
    wanted, last = table.strip().lower(), table.strip().lower().split(".")[-1]
    named = F.lower(F.concat_ws(".", text(f"{side}_schema"), text(f"{side}_table")))
    found = (named == wanted) | (F.lower(text(f"{side}_table")) == last)
    if f"{side}_component_name" in maps.columns:
        component = F.lower(text(f"{side}_component_name"))
        found = found | (component == wanted) | (F.element_at(F.split(component, r"\."), -1) == last)
    return found


def impact(maps: DataFrame, change: str, table: str, column: str = "", new: str = "", components: DataFrame | None = None) -> DataFrame:
    """Findings of a proposed change: drop_column, rename_column, drop_table, rename_table, change_type.

    Returns severity, category, package_id, task_id, side, other (the column at the map's other end)
    and n_maps. Columns that are dropped or renamed break each map at either end; tables break all
    maps of a task; a changed type calls for a look. components (package_id, task_id, name, sql) adds
    those whose SQL holds the name. A map with both ends counts at each end, and once for types.
    """
    findings = []
    hits = {s: matches_table(maps, s, table) & (F.lit(not column) | (F.lower(text(f"{s}_column")) == column.strip().lower())) for s in ("source", "target")}
    by_column = change in ("drop_column", "rename_column", "change_type")
    severity = "Warning" if change == "change_type" else "Critical"
    for side, other in (("source", "target"), ("target", "source")):
        here = hits[side] if change != "change_type" or side == "source" else hits["target"] & ~hits["source"]
        end = label(text(f"{other}_table"), text(f"{other}_column")) if by_column else F.lit("")
        found = maps.where(here).groupBy("package_id", "task_id", end.alias("other")).agg(F.count("*").alias("n_maps"))
        findings.append(found.select(F.lit(severity).alias("severity"), F.lit("Column Mapping").alias("category"), "package_id", "task_id", F.lit(side).alias("side"), "other", "n_maps"))
    if components is not None and change != "change_type":
        wanted = (column if by_column else table.split(".")[-1]).lower()
        rows = components.where(F.lower(F.coalesce("sql", F.lit(""))).contains(wanted))
        findings.append(rows.select(F.lit("Critical" if by_column else "Warning").alias("severity"), F.lit("Stored Procedure" if by_column else "Task").alias("category"), "package_id", "task_id", F.lit("sql").alias("side"), F.col("name").alias("other"), F.lit(1).cast("long").alias("n_maps")))
    out = findings[0]
    for more in findings[1:]:
        out = out.union(more)
    return out


def checklist(findings: DataFrame, change: str, table: str, column: str = "", new: str = "") -> DataFrame:
    """What to do before the change: one row for each distinct action and target, in order."""
    what = f"{table}.{column}" if column else table
    action = {"drop_column": f"Remove {what} from", "rename_column": f"Rename {what} to {new} in", "drop_table": f"Remove {what} from", "rename_table": f"Rename {what} to {new} in", "change_type": f"Check conversion of {what} to {new} in"}[change]
    rows = findings.select(F.when(F.col("severity") == "Critical", 1).otherwise(2).alias("priority"), F.lit(action).alias("action"), F.concat_ws(" / ", "package_id", "task_id").alias("target"))
    return rows.groupBy("action", "target").agg(F.min("priority").alias("priority")).select("priority", "action", "target")


def transitive_impact(maps: DataFrame, table: str, column: str) -> DataFrame:
    """All packages and tasks that the column reaches, beyond the maps it is named in."""
    reached = trace(maps, table, column, "down").select("source_node", F.col("source_column").alias("source_key"), "target_node", F.col("target_column").alias("target_key")).distinct()
    return keyed(maps).join(reached, ["source_node", "source_key", "target_node", "target_key"], "left_semi").groupBy("package_id", "task_id").agg(F.count("*").alias("n_maps"))


def contract(maps: DataFrame) -> DataFrame:
    """(table_name, column_name) of the contract that the maps imply: target columns but *."""
    return (
        maps.where((text("target_table") != "") & ~text("target_column").isin("", "*"))
        .groupBy(F.lower(label(text("target_schema"), text("target_table"))).alias("table_name"), F.lower("target_column").alias("column_name")).agg(F.count("*").alias("n_maps"))
    )


def contract_violations(spec: DataFrame, maps: DataFrame) -> DataFrame:
    """Differences between a contract (table_name, column_name, required) and the maps.

    Breaking: a table that is gone, or a required column of a table that is there; Additive: a column
    that the contract doesn't have.
    """
    actual = contract(maps).select("table_name", "column_name")
    wanted = spec.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"), "required")
    tables, known = actual.select("table_name").distinct(), wanted.select("table_name").distinct()
    gone = known.join(tables, "table_name", "left_anti").select("table_name", F.lit("").alias("column_name"), F.lit("Breaking").alias("severity"), F.lit("table missing").alias("reason"))
    lost = wanted.where("required").join(tables, "table_name", "left_semi").join(actual, ["table_name", "column_name"], "left_anti").select("table_name", "column_name", F.lit("Breaking"), F.lit("column missing"))
    more = actual.join(known, "table_name", "left_semi").join(wanted, ["table_name", "column_name"], "left_anti").select("table_name", "column_name", F.lit("Additive"), F.lit("new column"))
    return gone.union(lost).union(more)


def graph_keys(maps: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(kind, key) of the packages, tasks, components and maps of a graph, for comparing two of them.

    components has package_id, task_id, name and type.
    """
    source = label(text("source_schema"), text("source_table"), text("source_column"))
    target = label(text("target_schema"), text("target_table"), text("target_column"))
    keys = (
        maps.select(F.lit("package").alias("kind"), F.lower("package_id").alias("key"))
        .union(maps.select(F.lit("task"), F.lower(F.concat_ws("/", "package_id", "task_id"))))
        .union(maps.select(F.lit("mapping"), F.lower(F.concat(source, F.lit(" -> "), target, F.lit(" ["), text("operation_type"), F.lit("]")))))
    )
    if components is not None:
        keys = keys.union(components.select(F.lit("component"), F.lower(F.concat(F.concat_ws("/", "package_id", "task_id", "name"), F.lit(" ["), text("type"), F.lit("]")))))
    return keys.distinct()


def graph_diff(old: DataFrame, new: DataFrame, old_components: DataFrame | None = None, new_components: DataFrame | None = None) -> DataFrame:
    """(kind, change, key): keys only in new are added, keys only in old removed. One shuffle."""
    sides = graph_keys(old, old_components).withColumn("side", F.lit(1)).union(graph_keys(new, new_components).withColumn("side", F.lit(2)))
    return sides.groupBy("kind", "key").agg(F.sum("side").alias("side")).where("side < 3").select("kind", F.when(F.col("side") == 2, "added").otherwise("removed").alias("change"), "key")


def candidate_resolution(maps: DataFrame, owners: DataFrame) -> DataFrame:
    """Maps whose source is a list 'A | B', with the one table that owns the column where there is one.

    owners has table_name and column_name. Of no or several owners the list stays.
    Returns source_table, source_column, n_owners, resolved_table.
    """
    lists = maps.where(text("source_table").contains("|")).select("source_table", "source_column").distinct()
    parts = lists.select("source_table", "source_column", F.explode(F.split("source_table", r"\s*\|\s*")).alias("candidate"))
    owned = owners.select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct()
    found = parts.join(owned, (F.lower(F.trim("candidate")) == F.col("t")) & (F.lower(F.trim("source_column")) == F.col("c"))).groupBy("source_table", "source_column").agg(F.count("*").alias("n"), F.min("candidate").alias("one"))
    return lists.join(found, ["source_table", "source_column"], "left").select(
        "source_table", "source_column", F.coalesce("n", F.lit(0)).cast("long").alias("n_owners"), F.when(F.col("n") == 1, F.trim("one")).otherwise(F.col("source_table")).alias("resolved_table")
    )


def linked_servers(maps: DataFrame, servers: DataFrame) -> DataFrame:
    """maps with server names of either side replaced by those of servers (name, data_source)."""
    out = maps
    for side in ("source", "target"):
        own = servers.select(F.lower("name").alias(f"name_{side}"), F.col("data_source").alias(f"data_{side}"))
        out = out.join(own, F.lower(text(f"{side}_server")) == F.col(f"name_{side}"), "left").withColumn(f"{side}_server", F.coalesce(f"data_{side}", f"{side}_server")).drop(f"name_{side}", f"data_{side}")
    return out.select(*maps.columns)
