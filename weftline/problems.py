"""Queries p2, p3 and p5 over the engine's history, hierarchy and snapshot operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import name_key
from weftline.operators import hierarchy, history, snapshots
from weftline.session import table

MEMBER = ["nama_anggota", "email", "is_active"]


def member_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bitemporal ledger of anggota_feed."""
    return history.bitemporal_ledger(table(spark, sf_dir, "anggota_feed"), "id_anggota", MEMBER, "effective_date", "loaded_at", "feed_id", "row_action = 'D'")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each member with the period in which they held."""
    return history.current_versions(member_ledger(spark, sf_dir), "id_anggota", MEMBER).select(
        "id_anggota",
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit(history.OPEN_DATE)).alias("valid_to"),
    )


def p2_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger, with times as text; periods that are open end with null."""
    day, time = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"
    return member_ledger(spark, sf_dir).select(
        "id_anggota",
        *MEMBER,
        "removed",
        F.date_format("valid_from", day).alias("valid_from"),
        F.date_format("valid_to", day).alias("valid_to"),
        F.date_format("recorded_from", time).alias("recorded_from"),
        F.date_format("recorded_to", time).alias("recorded_to"),
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.column_links(table(spark, sf_dir, "column_link"), ("source_table", "source_column_name"), ("target_table", "target_column_name"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth, number of descendants and kind of each column in column_link."""
    return hierarchy.hierarchies(_links(spark, sf_dir))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path of each column in a tree, from its root down."""
    return hierarchy.paths(_links(spark, sf_dir)).select("node_key", F.array_join("path", " > ").alias("full_path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column with each other column that is derived from it."""
    return hierarchy.descendants(_links(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target columns added, removed or changed against the snapshot before."""
    return snapshots.snapshot_changes(
        table(spark, sf_dir, "map_snapshot"),
        "snapshot_date",
        {"package_id": F.col("package_id"), "target_table": name_key(F.col("target_table")), "target_column_name": name_key(F.col("target_column_name"))},
        {"source_expression": F.coalesce("source_expression", F.lit("")), "operation_type": F.col("operation_type")},
        ["delivered_at", "row_id"],
    ).withColumn("snapshot_date", F.date_format("snapshot_date", "yyyy-MM-dd"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_ledger": p2_ledger,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p5_found": p5_found,
}

_NODE = "lower(regexp_replace({0}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'))"
_USED = "{0} IS NOT NULL AND {0} NOT IN ('', '*')"
_LINKS = (
    "parts AS (SELECT "
    + ", ".join(f"{_NODE.format(c)} AS {a}" for c, a in (("source_table", "st"), ("source_column_name", "sc"), ("target_table", "tt"), ("target_column_name", "tc")))
    + " FROM column_link), links AS (SELECT DISTINCT st || '.' || sc AS parent, tt || '.' || tc AS child FROM parts WHERE "
    + " AND ".join(_USED.format(x) for x in ("st", "sc", "tt", "tc"))
    + " AND st || '.' || sc <> tt || '.' || tc)"
)

ORACLE: dict[str, str] = {
    "p2_found": """
WITH counted AS (
  SELECT *, row_number() OVER (PARTITION BY id_anggota, effective_date ORDER BY loaded_at DESC NULLS LAST, feed_id DESC) AS n
  FROM anggota_feed WHERE id_anggota IS NOT NULL AND effective_date IS NOT NULL
), marked AS (
  SELECT id_anggota, effective_date, coalesce(row_action = 'D', false) AS gone, nama_anggota, email, is_active,
    row_number() OVER w AS seq, lag(coalesce(row_action = 'D', false)) OVER w AS gone0,
    lag(nama_anggota) OVER w AS nama0, lag(email) OVER w AS email0, lag(is_active) OVER w AS active0
  FROM counted WHERE n = 1 WINDOW w AS (PARTITION BY id_anggota ORDER BY effective_date)
), versions AS (
  SELECT id_anggota, gone, effective_date, lead(effective_date) OVER (PARTITION BY id_anggota ORDER BY effective_date) AS ends
  FROM marked WHERE seq = 1 OR gone IS DISTINCT FROM gone0 OR nama_anggota IS DISTINCT FROM nama0
    OR email IS DISTINCT FROM email0 OR is_active IS DISTINCT FROM active0
)
SELECT id_anggota, strftime(effective_date, '%Y-%m-%d') AS valid_from,
  coalesce(strftime(ends, '%Y-%m-%d'), '9999-12-31') AS valid_to
FROM versions WHERE NOT gone""",
    "p2_ledger": """
WITH cells AS (
  SELECT id_anggota AS e, effective_date AS d, coalesce(loaded_at, TIMESTAMP '0001-01-01') AS k,
    arg_max({'removed': coalesce(row_action = 'D', false), 'nama': nama_anggota, 'email': email, 'active': is_active}, feed_id) AS s
  FROM anggota_feed WHERE id_anggota IS NOT NULL AND effective_date IS NOT NULL GROUP BY ALL
), told AS (SELECT *, row_number() OVER w AS n, lag(s) OVER w AS before FROM cells WINDOW w AS (PARTITION BY e, d ORDER BY k)),
states AS (SELECT e, d, s, k, lead(k) OVER (PARTITION BY e, d ORDER BY k) AS until FROM told WHERE n = 1 OR s IS DISTINCT FROM before),
firsts AS (SELECT e, d, min(k) AS k FROM cells GROUP BY ALL),
times AS (SELECT e, d, k AS t FROM firsts UNION SELECT a.e, a.d, b.k FROM firsts a JOIN firsts b ON b.e = a.e AND b.d > a.d AND b.k > a.k),
ends AS (SELECT t.e, t.d, t.t, min(b.d) AS ending FROM times t LEFT JOIN firsts b ON b.e = t.e AND b.d > t.d AND b.k <= t.t GROUP BY ALL),
turns AS (SELECT *, row_number() OVER w AS n, lag(ending) OVER w AS before FROM ends WINDOW w AS (PARTITION BY e, d ORDER BY t)),
spans AS (SELECT e, d, ending, t, lead(t) OVER (PARTITION BY e, d ORDER BY t) AS until FROM turns WHERE n = 1 OR ending IS DISTINCT FROM before)
SELECT s.e AS id_anggota, s.s.nama AS nama_anggota, s.s.email AS email, s.s.active AS is_active, s.s.removed AS removed,
  strftime(s.d, '%Y-%m-%d') AS valid_from, strftime(p.ending, '%Y-%m-%d') AS valid_to,
  strftime(greatest(s.k, p.t), '%Y-%m-%d %H:%M:%S') AS recorded_from, strftime(least(s.until, p.until), '%Y-%m-%d %H:%M:%S') AS recorded_to
FROM states s JOIN spans p ON p.e = s.e AND p.d = s.d
WHERE coalesce(greatest(s.k, p.t) < least(s.until, p.until), true)""",
    "p3_found": f"""
WITH RECURSIVE {_LINKS}, reach(top, node) AS (
  SELECT parent, child FROM links UNION SELECT r.top, l.child FROM reach r JOIN links l ON l.parent = r.node
), nodes AS (SELECT parent AS node FROM links UNION SELECT child FROM links),
loops AS (SELECT DISTINCT top AS node FROM reach WHERE top = node),
under AS (SELECT DISTINCT r.node FROM reach r JOIN loops l ON l.node = r.top WHERE r.node NOT IN (SELECT node FROM loops)),
walk(root, node, depth) AS (
  SELECT node, node, 0 FROM nodes WHERE node NOT IN (SELECT child FROM links)
  UNION ALL SELECT w.root, l.child, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.node
), below AS (SELECT top AS node, count(*) AS n FROM reach WHERE top <> node GROUP BY 1)
SELECT n.node AS node_key, coalesce(w.root, '') AS root_node, CAST(coalesce(w.depth, -1) AS BIGINT) AS node_depth,
  CAST(coalesce(b.n, 0) AS BIGINT) AS n_desc,
  CASE WHEN l.node IS NOT NULL THEN 'cycle' WHEN u.node IS NOT NULL THEN 'below' ELSE 'tree' END AS node_kind
FROM nodes n LEFT JOIN walk w ON w.node = n.node LEFT JOIN below b ON b.node = n.node
  LEFT JOIN loops l ON l.node = n.node LEFT JOIN under u ON u.node = n.node""",
    "p3_paths": f"""
WITH RECURSIVE {_LINKS}, nodes AS (SELECT parent AS node FROM links UNION SELECT child FROM links), walk(node, path) AS (
  SELECT node, node FROM nodes WHERE node NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, w.path || ' > ' || l.child FROM walk w JOIN links l ON l.parent = w.node
)
SELECT node AS node_key, path AS full_path FROM walk""",
    "p3_descendants": f"""
WITH RECURSIVE {_LINKS}, reach(top, node) AS (
  SELECT parent, child FROM links UNION SELECT r.top, l.child FROM reach r JOIN links l ON l.parent = r.node
)
SELECT top AS node_key, node AS descendant FROM reach WHERE top <> node""",
    "p5_found": """
WITH counted AS (
  SELECT snapshot_date, package_id, lower(trim(target_table)) AS target_table, lower(trim(target_column_name)) AS target_column_name,
    coalesce(source_expression, '') AS expression, operation_type,
    row_number() OVER (PARTITION BY snapshot_date, package_id, lower(trim(target_table)), lower(trim(target_column_name))
      ORDER BY delivered_at DESC NULLS LAST, row_id DESC) AS n
  FROM map_snapshot WHERE snapshot_date IS NOT NULL
), known AS (SELECT * FROM counted WHERE n = 1),
dates AS (SELECT snapshot_date AS d, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date FROM known)),
newer AS (SELECT k.*, d.before FROM known k JOIN dates d ON d.d = k.snapshot_date WHERE d.before IS NOT NULL),
older AS (SELECT k.*, d.d AS after FROM known k JOIN dates d ON d.before = k.snapshot_date)
SELECT strftime(coalesce(a.snapshot_date, b.after), '%Y-%m-%d') AS snapshot_date, coalesce(a.package_id, b.package_id) AS package_id,
  coalesce(a.target_table, b.target_table) AS target_table, coalesce(a.target_column_name, b.target_column_name) AS target_column_name,
  CASE WHEN b.after IS NULL THEN 'added' WHEN a.snapshot_date IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM newer a FULL JOIN older b ON b.after = a.snapshot_date AND b.package_id IS NOT DISTINCT FROM a.package_id
  AND b.target_table IS NOT DISTINCT FROM a.target_table AND b.target_column_name IS NOT DISTINCT FROM a.target_column_name
WHERE b.after IS NULL OR a.snapshot_date IS NULL OR a.expression <> b.expression OR a.operation_type IS DISTINCT FROM b.operation_type""",
}
