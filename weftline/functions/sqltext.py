"""Small column functions on SQL texts and server names, and a formatter for SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.sources import tsql

# Identifiers that are written in brackets where they qualify a name.
RESERVED = (
    "external user order table select from where group key index view schema database file function procedure trigger constraint column row "
    "value values primary foreign check default null not and or"
).split()
# The server that stands for the local machine in containers, and the default port.
LOCAL_SERVER, PORT = "172.17.0.1,1433", "1433"


def escape_reserved(sql: Column) -> Column:
    """sql with reserved words in brackets where they qualify a name: external.T becomes [external].T."""
    return F.regexp_replace(sql, rf"(?i)\b({'|'.join(RESERVED)})\.", "[$1].")


def server_address(server: Column) -> Column:
    """A server with its port; blank names, '.' and localhost are the machine that runs the container."""
    name = F.trim(F.coalesce(server, F.lit("")))
    local = name.isin("", ".") | F.lower(name).startswith("localhost")
    return F.when(local, LOCAL_SERVER).when(name.contains(","), server).otherwise(F.concat(server, F.lit(f",{PORT}")))


def references_variable(text: Column, variable: str) -> Column:
    """Whether a text names a variable, written @[Scope::Name], letter case ignored; null names none."""
    return F.coalesce(F.lower(text).contains(f"@[{variable.lower()}]"), F.lit(False))


def format_sql(sql: str | None) -> str:
    """sql with each clause on its own line and keywords in upper case; literals and names stay as they are."""
    clauses = {"select", "from", "where", "group", "having", "order", "insert", "update", "delete", "merge", "using", "values", "set", "union", "join", "left", "right", "inner", "full", "cross", "when", "on", "with", "exec", "declare"}
    words = clauses | {"by", "as", "and", "or", "not", "null", "in", "is", "into", "outer", "all", "then", "matched", "case", "else", "end", "distinct", "top", "like", "between", "exists"}
    starts = {"left", "right", "inner", "full", "cross"}
    out: list[str] = []
    depth, before = 0, ""
    for part in re.findall(r"'(?:[^']|'')*'|\[[^\]]*\]|--[^\n]*|/\*.*?\*/|[\w@#$.]+|\S", sql or "", re.DOTALL):
        low = part.lower()
        text = part.upper() if low in words else part
        fresh = low in clauses and depth == 0 and out and not (low == "join" and before in (*starts, "outer")) and not (low == "on" and before == "")
        if fresh:
            out.append("\n" + ("    " if low == "on" else "") + text)
        elif part in ",);." or not out:
            out.append(text)
        else:
            out.append(("" if before == "(" or part == "(" and before not in words else " ") + text)
        depth += (part == "(") - (part == ")")
        before = low
    return "".join(out)


def tokens(sql: str | None) -> list[tuple[str, str]]:
    """(kind, text) of the words, literals and signs of sql, for highlighting."""
    return [(t.kind, t.text) for t in tsql.tokenize(sql or "")]
