"""Column functions on ETL metadata: types, recommendations, redaction, labels, glossary."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names whose values are secret, as they stand before '='.
SECRETS = "password|pwd|accountkey|account key|sharedaccesskey|secret|apikey|api key|token"
_SECRET = rf"(?i)\b({SECRETS})(\s*=\s*)[^;\"'\s<>&]+"


def redact(column: Column) -> Column:
    """column with the values of secrets replaced; doing it twice changes nothing more."""
    return F.regexp_replace(column, _SECRET, "$1$2***REDACTED***")


def redact_text(value: str) -> str:
    """The same for one text."""
    return re.sub(_SECRET, r"\1\2***REDACTED***", value)


def _has(column: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.lower(F.coalesce(column, F.lit(""))).contains(w)
    return found


# The target of a modernization for each kind of task and component.
TASK_ADVICE = [(("executesqltask", "execute sql task"), "dbt pre/post-hook or PythonOperator"), (("pipelinetask", "data flow"), "dbt Model (SQL)"), (("executepackagetask", "execute package"), "Airflow SubDAG or TriggerDagRunOperator"), (("scripttask", "script task"), "PythonOperator"), (("sendmailtask", "send mail"), "Airflow EmailOperator")]
COMPONENT_ADVICE = [(("source",), "Python Extraction (pyodbc/pandas)"), (("destination",), "Python Load (to Landing) or dbt Materialization"), (("derived column", "lookup", "conditional split", "aggregate"), "dbt Model (SQL)"), (("sort",), "dbt Model (ORDER BY)"), (("union all",), "dbt Model (UNION ALL)"), (("script component",), "Python / PySpark")]
# Vendors of components that aren't part of the product.
VENDORS = ["cozyroc", "kingswaysoft", "zappysys", "pragmatic works", "devart", "attunity", "theobald", "melissa"]


def _advice(column: Column, table: list[tuple[tuple[str, ...], str]], other: str) -> Column:
    out = F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "")
    for words, what in table:
        out = out.when(_has(column, *words), what)
    return out.otherwise(other)


def task_advice(kind: Column) -> Column:
    """What a task of this type should become; empty for an empty type."""
    return _advice(kind, TASK_ADVICE, "Airflow Operator")


def component_advice(kind: Column) -> Column:
    """What a component of this type should become; empty for an empty type."""
    return _advice(kind, COMPONENT_ADVICE, "dbt Transformation")


def is_script(kind: Column, name: Column) -> Column:
    """Whether a component is a script."""
    return _has(F.concat_ws(" ", kind, name), "scriptcomponenthost", "txscript", "script component")


def is_third_party(kind: Column, name: Column) -> Column:
    """Whether a component comes from another vendor: by a known name, or a class id of its own."""
    foreign = F.coalesce(kind, F.lit("")).contains("{") & ~_has(kind, "microsoft")
    return ~is_script(kind, name) & (_has(F.concat_ws(" ", kind, name), *VENDORS) | foreign)


# The usual names of component types, by what their class names hold.
USUAL_TYPES = [("derivedcolumn", "Derived Column"), ("oledbsource", "OLE DB Source"), ("oledbdestination", "OLE DB Destination"), ("lookup", "Lookup"), ("aggregate", "Aggregate"), ("sort", "Sort")]


def component_type(kind: Column, name: Column) -> Column:
    """The usual name of a component's type."""
    out = F.when(is_script(kind, name), "Script Component")
    out = out.when(is_third_party(kind, name), F.concat(F.lit("Third-Party: "), F.when(F.trim(F.coalesce(name, F.lit(""))) != "", name).otherwise("Unknown")))
    out = out.when(F.trim(F.coalesce(kind, F.lit(""))) == "", "Component")
    for word, usual in USUAL_TYPES:
        out = out.when(_has(kind, word), usual)
    return out.otherwise(kind)


def operation_label(operation: Column) -> Column:
    """An operation as diagrams show it: without its prefix, blanks for underscores."""
    plain = F.regexp_replace(F.regexp_replace(operation, "^SQL_PROC_", ""), "^XML_FALLBACK$", "DATA FLOW")
    return F.replace(plain, F.lit("_"), F.lit(" "))


# Business terms of the estate's language.
GLOSSARY = {
    "anggota": "member", "simpanan": "savings", "pinjaman": "loan", "angsuran": "instalment", "cabang": "branch", "nasabah": "customer", "tagihan": "bill", "denda": "fine",
    "bunga": "interest", "saldo": "balance", "tanggal": "date", "jumlah": "amount", "nama": "name", "kode": "code", "nomor": "number", "jenis": "kind", "nilai": "value",
    "barang": "goods", "gudang": "warehouse", "pelanggan": "customer", "pegawai": "employee", "wilayah": "region", "produk": "product",
}


def load_glossary(path: str | None = None) -> dict[str, str]:
    """The glossary, with the terms of a JSON file added or put in place of its own."""
    own = dict(GLOSSARY)
    if path and Path(path).exists():
        own |= {k.lower(): v for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items()}
    return own


def translate(name: Column, glossary: dict[str, str]) -> Column:
    """name in business terms: the whole name, the name without its schema, else part by part."""
    terms = F.create_map(*[x for k, v in glossary.items() for x in (F.lit(k), F.lit(v))])
    low = F.lower(name)
    bare = F.element_at(F.split(low, r"\."), -1)
    parts = F.transform(F.split(F.element_at(F.split(name, r"\."), -1), "_"), lambda p: F.coalesce(F.try_element_at(terms, F.lower(p)), p))
    return F.coalesce(F.try_element_at(terms, low), F.try_element_at(terms, bare), F.array_join(parts, " "))
