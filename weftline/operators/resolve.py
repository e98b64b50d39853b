"""Resolving what a graph leaves open: join keys of lookups, servers, child packages, task ids, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.lineage import label, search, text

#: How task and package ids of older exports begin.
_PREFIX = r"Package\\"
# Endings of column names that are taken for join keys, in order of preference.
KEY_ENDINGS = ["code", "key", "id", "no"]
# Words of a task's name that say nothing about the package it runs.
PLAIN_WORDS = ["execute", "pkg", "dag", "task", "package", ""]


def lookup_keys(rows: list[str], reference: list[str], operations: list[str] | None = None, earlier: dict[str, str] | None = None) -> tuple[dict[str, str], str]:
    """(keys, tier) of a lookup: input column to reference column, and what they were found by.

    rows and reference are the columns of both sides, operations those of the maps that enter the
    lookup, earlier the columns that lookups before it added, with their lookup. The first that holds
    is taken: 'metadata' (an operation LOOKUP_JOIN:input=reference), 'common' (a column of that name
    on both sides), 'date' (a ...Date column and FullDate or DateKey), 'chained' (a column that an
    earlier lookup added), 'suffix' (an input column that ends in code, key, id or no, whose ending
    one reference column alone shares; of several the one that shares most of its end), 'none': no keys. Letter case is ignored throughout.
    """
    own, other = {c.lower(): c for c in rows}, {c.lower(): c for c in reference}
    before = {c.lower() for c in earlier or {}}
    for operation in operations or []:
        head, _, pair = operation.partition(":")
        left, _, right = pair.partition("=")
        if head.upper() == "LOOKUP_JOIN" and left.strip().lower() in own and right.strip().lower() in other:
            return {own[left.strip().lower()]: other[right.strip().lower()]}, "metadata"
    common = [c for c in own if c in other and c not in before]
    if common:
        return {own[common[0]]: other[common[0]]}, "common"
    dates, days = [c for c in own if c.endswith("date")], [c for c in ("fulldate", "datekey") if c in other]
    if dates and days:
        return {own[dates[0]]: other[days[0]]}, "date"
    chained = [c for c in before if c in other and c in own]
    if chained:
        return {own[chained[0]]: other[chained[0]]}, "chained"
    for ending in KEY_ENDINGS:
        ours = [c for c in own if c.endswith(ending)]
        theirs = [c for c in other if c.endswith(ending)]
        if ours and len(theirs) == 1:
            shared = lambda c, t=theirs[0]: next((k for k in range(min(len(c), len(t))) if c[-1 - k] != t[-1 - k]), min(len(c), len(t)))
            return {own[max(ours, key=shared)]: other[theirs[0]]}, "suffix"
    return {}, "none"


def supplier(column: str, source: list[str], lookups: dict[str, list[str]]) -> str:
    """Which input of a joined row supplies a column: the last lookup whose reference has it, else ''.

    References are known by their real columns, so no name is guessed. A column that the source has
    itself is taken from there.
    """
    low = column.lower()
    if low in {c.lower() for c in source}:
        return ""
    return next((name for name, columns in reversed(list(lookups.items())) if low in {c.lower() for c in columns}), "")


def task_key(task: Column) -> Column:
    """The part of a task's id that all ways to write it share: no prefix, braces or owner, lower case."""
    bare = F.regexp_replace(F.regexp_replace(task, _PREFIX, ""), r"^[{}]+|[{}]+$", "")
    return F.lower(F.element_at(F.split(bare, "::"), -1))


def task_matches(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) of edges between known tasks, by their own ids, however the edges write them."""
    known = tasks.select(F.col("task_id"), task_key(F.col("task_id")).alias("key")).groupBy("key").agg(F.min("task_id").alias("task_id"))
    side = lambda c: known.select(F.col("task_id").alias(f"{c}_id"), F.col("key").alias(f"{c}_key"))
    keyed = edges.select(task_key(F.col("src")).alias("src_key"), task_key(F.col("dst")).alias("dst_key"))
    return keyed.join(side("src"), "src_key").join(side("dst"), "dst_key").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()


def servers_and_databases(components: DataFrame, maps: DataFrame, side: str = "target", default: tuple[str, str] = ("", "")) -> DataFrame:
    """(component_id, server, database, tier) of every component, by the first tier that knows a database.

    components has component_id, package_id, name, server and database, the last two of its own
    connection. Tiers: 1 its connection, 2 maps of the component, 3 maps of its package, 4 another
    connection of its package, 5 maps of the project, 6 the default, as set by the environment. Within
    a tier the least (database, server) counts. Empty texts are missing.
    """
    db, srv = text(f"{side}_database"), text(f"{side}_server")
    known = maps.where(db != "").select("package_id", text(f"{side}_component_id").alias("cid"), F.struct(db.alias("database"), srv.alias("server")).alias("found"))
    by_component = known.where("cid <> ''").groupBy("cid").agg(F.min("found").alias("t2"))
    by_package = known.groupBy("package_id").agg(F.min("found").alias("t3"))
    own = F.when(text("database") != "", F.struct(text("database").alias("database"), text("server").alias("server")))
    c = components.select("component_id", "package_id", own.alias("t1"))
    other = c.where("t1 is not null").groupBy("package_id").agg(F.min("t1").alias("t4"))
    project = known.agg(F.min("found").alias("t5"))  # one row
    last = F.struct(F.lit(default[1]).alias("database"), F.lit(default[0]).alias("server"))
    joined = c.join(by_component, c["component_id"] == by_component["cid"], "left").join(by_package, "package_id", "left").join(other, "package_id", "left").join(F.broadcast(project))
    tiers = [F.col(f"t{n}") for n in range(1, 6)]
    tier = F.coalesce(*[F.when(t.isNotNull(), F.lit(n)) for n, t in enumerate(tiers, 1)], F.lit(6))
    chosen = F.coalesce(*tiers, last)
    return joined.select("component_id", chosen["server"].alias("server"), chosen["database"].alias("database"), tier.alias("tier"))


def _dag(name: Column, *heads: str) -> Column:
    out = F.lower(F.regexp_replace(F.regexp_replace(name, r"(?i)\.dtsx$", ""), r"[^A-Za-z0-9_]+", "_"))
    for head in heads:
        out = F.regexp_replace(out, f"^{head}", "")
    return F.concat(F.lit("dag_"), out)


def child_dags(tasks: DataFrame, packages: DataFrame, invokes: DataFrame) -> DataFrame:
    """(task_id, dag_id, tier) of the package that each task runs.

    tasks has task_id, name, description; packages has package_id and name; invokes has src (task) and
    dst (package). Tiers: 1 a package that the task invokes, 2 the package its description names,
    3 a package whose name holds two or all of the words of the task's name, 4 the task's own name.
    Of several packages the shortest name counts, then the least. Packages are joined by the words of tasks, so only
    names that share a word are compared.
    """
    invoked = invokes.join(packages.withColumnRenamed("name", "package"), invokes["dst"] == packages["package_id"]).groupBy(F.col("src").alias("task_id")).agg(F.min("package").alias("invoked"))
    words = tasks.select("task_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: ~w.isin(PLAIN_WORDS)))).alias("word"))
    counts = words.groupBy("task_id").agg(F.count("*").alias("held"))
    # A word is met as a part of a package's name: all parts of a name that begin at a word's place
    name = F.lower("name")
    parts = packages.select(F.col("name").alias("package"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.transform(F.sequence(F.lit(1), F.length(name) - i + 1), lambda n: F.substring(name, i, n)))))).alias("word"))
    met = words.join(parts, "word").groupBy("task_id", "package").agg(F.count("*").alias("n")).join(counts, "task_id")
    guessed = met.where("n >= 2 or n = held").groupBy("task_id").agg(F.min(F.struct(F.length("package").alias("size"), "package"))["package"].alias("guessed"))
    described = F.when(F.trim(text("description")) != "", F.element_at(F.split(F.trim(text("description")), r"[/\\]"), -1))
    full = tasks.join(invoked, "task_id", "left").join(guessed, "task_id", "left")
    tier = F.when(F.col("invoked").isNotNull(), 1).when(described.isNotNull(), 2).when(F.col("guessed").isNotNull(), 3).otherwise(4)
    dag = F.when(tier < 4, _dag(F.coalesce("invoked", described, "guessed"), "pkg_")).otherwise(_dag(F.col("name"), "pkg_", "execute_"))
    return full.select("task_id", dag.alias("dag_id"), tier.alias("tier"))


def target_resolution(maps: DataFrame, term: str) -> DataFrame:
    """(scope, display): the one table or column that a typed term means; no row where nothing fits.

    In order: the column written so, the table written so, the first column that holds the term, the
    first such table.
    """
    hits = [search(maps, term, scope).select(F.lit(scope).alias("scope"), "display") for scope in ("column", "table")]
    exact = F.lower("display") == term.strip().lower()
    rank = F.when(exact & (F.col("scope") == "column"), 0).when(exact, 1).when(F.col("scope") == "column", 2).otherwise(3)
    return hits[0].union(hits[1]).orderBy(rank, F.lower("display")).limit(1)


def palette(maps: DataFrame, term: str, most: int = 20) -> DataFrame:
    """(kind, item) of packages, tables and columns that hold a text, in order; most is the list's length."""
    table = label(text("target_schema"), text("target_table"))
    rows = maps.select(F.explode(F.array(
        F.struct(F.lit("package").alias("kind"), text("package_id").alias("item")), F.struct(F.lit("table").alias("kind"), table.alias("item")),
        F.struct(F.lit("column").alias("kind"), F.when(text("target_column") != "", label(table, text("target_column"))).otherwise("").alias("item")),
    )).alias("x")).select("x.*").distinct()
    return rows.where((F.col("item") != "") & F.lower("item").contains(term.strip().lower())).orderBy("kind", F.lower("item"), "item").limit(most)


def suggested_questions(maps: DataFrame, most: int = 3) -> DataFrame:
    """Questions about tables and columns of the graph, most of each, chosen by the hash of their names."""
    ends = lambda column: maps.select(column.alias("x")).where("x <> ''").distinct().orderBy(F.xxhash64("x"), "x").limit(most)
    tables, columns = ends(label(text("target_schema"), text("target_table"))), ends(text("target_column"))
    return tables.select(F.concat(F.lit("Which packages write to "), F.col("x"), F.lit("?")).alias("question")).union(columns.select(F.concat(F.lit("Where does "), F.col("x"), F.lit(" come from?"))))


def recent_projects(uses: DataFrame, most: int = 8) -> DataFrame:
    """(path, last_used) of the projects used last; uses has path and used_at, paths ignore letter case."""
    newest = Window.partitionBy(F.lower("path")).orderBy(F.desc("used_at"), "path")
    return uses.withColumn("n", F.row_number().over(newest)).where("n = 1").select("path", F.col("used_at").alias("last_used")).orderBy(F.desc("last_used"), "path").limit(most)


def impact_counters(findings: DataFrame) -> DataFrame:
    """One row: affected packages, mappings, procedures and tasks of findings, and whether one is critical."""
    category = lambda name: F.count_if(F.col("category") == name)
    return findings.agg(
        F.count_distinct(F.lower("package_id")).alias("packages"), category("Column Mapping").alias("mappings"), category("Stored Procedure").alias("procedures"), category("Task").alias("tasks"),
        F.coalesce(F.bool_or(F.col("severity") == "Critical"), F.lit(False)).alias("has_critical"),
    )


def trace_tables(edges: DataFrame) -> DataFrame:
    """One row: the number of tables that the edges of a trace touch."""
    return edges.select(F.explode(F.array("source_node", "target_node")).alias("node")).agg(F.count_distinct(F.lower("node")).alias("n_tables"))


def object_edges(maps: DataFrame) -> DataFrame:
    """(rel, src, dst, n, n_out): packages contain tasks, tasks write tables; n_out are the edges that leave src, containment aside."""
    contains = maps.select("package_id", "task_id").distinct().select(F.lit("contains").alias("rel"), F.col("package_id").alias("src"), F.col("task_id").alias("dst"), F.lit(1).cast("long").alias("n"))
    writes = maps.groupBy("task_id", label(text("target_schema"), text("target_table")).alias("dst")).agg(F.count("*").alias("n")).select(F.lit("writes"), "task_id", "dst", "n")
    edges = contains.union(writes)
    out = edges.where("rel <> 'contains'").groupBy("src").agg(F.count("*").alias("n_out"))
    return edges.join(out, "src", "left").select("rel", "src", "dst", "n", F.coalesce("n_out", F.lit(0)).alias("n_out"))
