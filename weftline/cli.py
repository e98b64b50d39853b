"""Command line: python -m weftline.cli scan | convert | labels | trace | diff | risk | whatif | ask."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import lineage as L
from weftline.operators import questions as Q
from weftline.plans import convert, scan
from weftline.session import local_session
from weftline.sinks import exports, reports
from weftline.sources.loads import load_graph, load_settings
from weftline.sources.packages import read_packages


def _maps(spark: SparkSession, path: str) -> DataFrame:
    """Maps of a folder of packages, of a saved graph, or a Parquet table of maps."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".json"):
        return load_graph(spark, path)["columnMappings"]
    return scan.scan(spark, path)


def _show(rows: DataFrame) -> None:
    """Print a table as CSV, row by row."""
    print(",".join(rows.columns))
    for row in rows.toLocalIterator():
        print(",".join(f'"{str(v).replace(chr(34), chr(34) * 2)}"' if v is not None else "" for v in row))


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: nothing found; 2: wrong use."""
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *more: [sub.add_parser(name)] and [sub.choices[name].add_argument(m) for m in ("maps", *more)]
    add("scan", "out")
    add("convert", "target", "out")
    sub.choices["convert"].add_argument("--config")
    add("labels", "term")
    add("diff", "new")
    add("risk")
    add("ask", "question")
    add("trace", "table")
    sub.choices["trace"].add_argument("--column")
    sub.choices["trace"].add_argument("--direction", choices=["up", "down", "both"], default="both")
    add("whatif", "change", "table")
    sub.choices["whatif"].add_argument("--column", default="")
    sub.choices["whatif"].add_argument("--new", default="")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.getActiveSession() or local_session()
    if a.command == "convert":
        if a.target not in convert.TARGETS:
            return 2
        made = convert.convert(read_packages(spark, a.maps), a.target)
        settings = load_settings(a.config)["connectionManagers"]
        made[".env"], made[".env.example"] = convert.env_pair(settings)
        names = reports.workspace(made, a.out, [str(f) for f in Path(a.maps).rglob("*.dtsx")])
        print("\n".join(names))
        return 0 if len(made) > 3 else 1
    maps = _maps(spark, a.maps)
    if a.command == "scan":
        report = L.column_lineage_report(maps)
        maps.write.mode("overwrite").parquet(f"{a.out}/column_maps.parquet")
        for name, lines in (("lineage.cypher", exports.cypher(maps)), ("lineage.mmd", exports.mermaid(maps)), ("openlineage.jsonl", exports.openlineage(maps)), ("lineage.csv", reports.lineage_export(maps)), ("lineage.json", reports.graph_json({"columnMappings": maps})), ("risk.md", reports.risk_markdown(L.risk_scores(maps))), ("report.md", exports.markdown("Lineage", {"Column mappings": report}))):
            exports.write_lines(lines, f"{a.out}/{name}")
        return 0
    if a.command == "labels":
        found = L.search(maps, a.term, "table").union(L.search(maps, a.term, "column"))
    elif a.command == "diff":
        found = L.graph_diff(maps, _maps(spark, a.new)).orderBy("kind", "change", "key")
    elif a.command == "risk":
        found = L.risk_scores(maps).orderBy(L.F.desc("score"), "table_name")
    elif a.command == "ask":
        found = Q.answer(maps, a.question)
    elif a.command == "trace":
        found = L.trace(maps, a.table, a.column, a.direction).orderBy("step_rank", "source_node", "target_node")
    else:
        found = L.impact(maps, a.change, a.table, a.column, a.new).orderBy("severity", "package_id")
    if not found.take(1):
        print("nothing found", file=sys.stderr)
        return 1
    _show(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
