"""Column lineage from T-SQL text: a tokenizer and a recursive-descent reader of statements.

Spark's own parser doesn't take brackets, UPDATE ... FROM, SELECT INTO or EXEC, so the statements are
read here. Only what moves columns is understood; other statements are passed over, and one that
can't be read costs no other. Set at a time it runs over a column of SQL texts with mapInPandas.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*)|(?P<comment>/\*)|(?P<text>[Nn]?'(?:[^']|'')*')|(?P<name>\[(?:[^\]]|\]\])*\]|\"[^\"]*\"|[A-Za-z_#][\w#$@]*)|(?P<variable>@@?[\w#$@]+)"
    r"|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<sign><>|<=|>=|!=|\+=|-=|\*=|/=|::|.)",
    re.S,
)
# Words that begin a statement.
STARTS = set("INSERT UPDATE DELETE MERGE SELECT WITH EXEC EXECUTE DECLARE SET IF ELSE WHILE BEGIN END RETURN PRINT TRUNCATE CREATE ALTER DROP GO COMMIT ROLLBACK THROW RAISERROR USE WAITFOR GRANT OPEN CLOSE FETCH DEALLOCATE SAVE".split())
# Words that are no column, alias or table.
WORDS = set(
    "SELECT FROM WHERE GROUP BY HAVING ORDER ON AND OR NOT NULL IS IN LIKE BETWEEN EXISTS CASE WHEN THEN ELSE END AS DISTINCT TOP ALL ANY SOME UNION EXCEPT INTERSECT JOIN INNER LEFT RIGHT FULL OUTER CROSS APPLY "
    "INTO VALUES SET ASC DESC OVER PARTITION ROWS RANGE WITH OPTION FOR XML PATH PERCENT TIES COLLATE ESCAPE USING MATCHED TARGET SOURCE OUTPUT INSERTED DELETED DEFAULT TRUE FALSE "
    "INT BIGINT SMALLINT TINYINT BIT VARCHAR NVARCHAR CHAR NCHAR TEXT DATE DATETIME DATETIME2 TIME DECIMAL NUMERIC FLOAT REAL MONEY UNIQUEIDENTIFIER VARBINARY MAX "
    "YEAR MONTH DAY HOUR MINUTE SECOND QUARTER WEEK DAYOFYEAR WEEKDAY MILLISECOND PRECEDING FOLLOWING UNBOUNDED CURRENT ROW CURRENT_TIMESTAMP".split()
)
JOINS = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER"}
HEADS = ("INTO", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "OPTION", "FOR")
FIELDS = [f"{s}_{p}" for s in ("source", "target") for p in ("server", "database", "schema", "table", "column")]
SCHEMA = "procedure_name string, operation_type string, " + ", ".join(f"{f} string" for f in FIELDS) + ", source_expression string, join_details string, filter_conditions string"


@dataclass(frozen=True)
class Tok:
    kind: str
    text: str

    @property
    def word(self) -> str:
        """The token as a keyword; names in brackets or quotes are none."""
        return self.text.upper() if self.kind == "name" and self.text[0] not in '["' else self.text if self.kind == "sign" else ""

    @property
    def name(self) -> str:
        return self.text[1:-1].replace("]]", "]") if self.text[0] in '["' else self.text


@dataclass(frozen=True)
class Table:
    """A table's name in four parts; derived tables and common table expressions have no schema."""

    server: str = ""
    database: str = ""
    schema: str = ""
    table: str = ""


@dataclass
class Scope:
    """What a query can name: tables by alias, in order, within the scope around it."""

    tables: dict[str, Table | None] = field(default_factory=dict)
    outer: Scope | None = None
    joins: list[str] = field(default_factory=list)
    opaque: bool = False  # a remote query is among the tables; its own columns are recorded with it


def tokenize(sql: str) -> list[Tok]:
    """The tokens of sql without blanks and comments, which may be nested."""
    out, at = [], 0
    while at < len(sql):
        found = TOKEN.match(sql, at)
        if not found:
            break
        kind, at = found.lastgroup or "sign", found.end()
        if kind == "comment":
            depth = 1
            while depth and at < len(sql):
                step = re.compile(r"/\*|\*/").search(sql, at)
                if not step:
                    at = len(sql)
                    break
                depth += 1 if step[0] == "/*" else -1
                at = step.end()
        elif kind != "space":
            out.append(Tok(kind, found[0]))
    return out


def text_of(own: list[Tok]) -> str:
    """Tokens joined to readable SQL."""
    joined = re.sub(r"\s*([.,)])", r"\1", re.sub(r"([.(])\s*", r"\1", " ".join(t.text for t in own)))
    return re.sub(r"\b(\w+) \(", lambda m: m[0] if m[1].upper() in WORDS | STARTS else f"{m[1]}(", joined)


def literal(token: Tok) -> str:
    return re.sub(r"^[Nn]?'|'$", "", token.text).replace("''", "'")


def split(own: list[Tok], *marks: str) -> list[list[Tok]]:
    """own parted at marks outside of brackets and CASE ... END."""
    out: list[list[Tok]] = [[]]
    depth = 0
    for t in own:
        depth += (t.word in ("(", "CASE")) - (t.word in (")", "END"))
        if depth == 0 and t.word in marks:
            out.append([])
        else:
            out[-1].append(t)
    return out


def find(own: list[Tok], words: tuple[str, ...] | set[str], begin: int = 0) -> int:
    """The first of words outside of brackets and CASE ... END, or the length of own."""
    depth = 0
    for k in range(begin, len(own)):
        w = own[k].word
        if depth == 0 and w in words:
            return k
        depth += (w in ("(", "CASE")) - (w in (")", "END"))
    return len(own)


def closing(own: list[Tok], at: int) -> int:
    """Where the bracket that opens at a place closes."""
    depth = 0
    for k in range(at, len(own)):
        depth += (own[k].word == "(") - (own[k].word == ")")
        if not depth:
            return k
    return len(own) - 1


def positional(sql: str) -> str:
    """sql with each ? marker outside of texts and comments as @P0, @P1 and so on."""
    count = iter(range(10**9))
    return "".join(f"@P{next(count)}" if t == "?" else t for t in re.findall(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|\?|[^'?/-]+|.", sql, re.S))


def procedure_reference(text: str) -> tuple[str, str] | None:
    """(schema, name) of a procedure that is called or named; None for statements and blanks."""
    own = tokenize(text or "")
    if own and own[0].word in ("EXEC", "EXECUTE"):
        own = own[1:]
    if len(own) > 2 and own[0].kind == "variable" and own[1].text == "=":
        own = own[2:]
    if not own or own[0].kind != "name" or own[0].word in STARTS | {"FROM"}:
        return None
    parts = [own[0].name]
    at = 1
    while at + 1 < len(own) and own[at].text == "." and own[at + 1].kind == "name":
        parts.append(own[at + 1].name)
        at += 2
    return (parts[-2] if len(parts) > 1 else "dbo", parts[-1])


class Reader:
    """Reads statements to lineage records."""

    def __init__(self, database: str = "", server: str = "", variables: dict[str, str] | None = None, depth: int = 0) -> None:
        self.database, self.server, self.depth = database, server, depth
        self.values = {k.lower(): v for k, v in (variables or {}).items()}
        self.procedure = "AdHoc"
        self.records: list[dict[str, str]] = []
        self.ctes: set[str] = set()

    # names

    def table(self, parts: list[str]) -> Table:
        """A name of one to four parts; names of common table expressions have no schema."""
        if len(parts) == 1 and parts[0].lower() in self.ctes:
            return Table(table=parts[0])
        full = [""] * (4 - len(parts)) + parts[-4:]
        server, database, schema, name = full
        return Table(server or self.server, database or self.database, schema or "dbo", name)

    def name_at(self, own: list[Tok], at: int) -> tuple[list[str], int]:
        parts = [own[at].name]
        at += 1
        while at + 1 < len(own) and own[at].text == ".":
            if own[at + 1].text == ".":
                parts.append("")
                at += 1
            elif own[at + 1].kind == "name" or own[at + 1].text == "*":
                parts.append(own[at + 1].name)
                at += 2
            else:
                break
        return parts, at

    def add(self, operation: str, source: Table, column: str, target: Table, target_column: str, expression: str = "", joins: str = "", where: str = "") -> None:
        made = {"procedure_name": self.procedure, "operation_type": operation, "source_expression": expression, "join_details": joins, "filter_conditions": where}
        for side, t, c in (("source", source, column), ("target", target, target_column)):
            made |= {f"{side}_server": t.server, f"{side}_database": t.database, f"{side}_schema": t.schema, f"{side}_table": t.table, f"{side}_column": c}
        if made not in self.records:
            self.records.append(made)

    # statements

    def read(self, sql: str) -> list[dict[str, str]]:
        self.own, self.at = tokenize(sql), 0
        while self.at < len(self.own):
            begin = self.at
            try:
                self.statement()
            except (IndexError, ValueError, RecursionError):
                pass
            if self.at <= begin:
                self.at = begin + 1
        return self.records

    def until_next(self, begin: int, inner: set[str] = frozenset()) -> list[Tok]:
        """The rest of the statement: up to ';' or a word that begins another."""
        depth, k, before = 0, begin, ""
        while k < len(self.own):
            w = self.own[k].word
            depth += (w in ("(", "CASE")) - (w == ")" or (w == "END" and depth > 0))
            if depth == 0 and (w == ";" or (w in STARTS and w not in inner and not (w == "SELECT" and before in ("UNION", "ALL", "EXCEPT", "INTERSECT")) and not (w == "WITH" and k + 1 < len(self.own) and self.own[k + 1].word == "(") and not (w == "END" and before == "CASE"))):
                break
            before = w
            k += 1
        self.at = k
        return self.own[begin:k]

    def statement(self) -> None:
        own, at = self.own, self.at
        word = own[at].word
        following = own[at + 1].word if at + 1 < len(own) else ""
        if word in ("CREATE", "ALTER"):
            k = at + 1 + 2 * (following == "OR")
            if own[k].word in ("PROC", "PROCEDURE"):
                parts, k = self.name_at(own, k + 1)
                self.procedure = parts[-1]
                while own[k].word != "AS" or own[k - 1].kind == "variable":
                    k += 1
                self.at = k + 1
            else:
                self.until_next(at + 1)
        elif word == "GO":
            self.procedure, self.at = "AdHoc", at + 1
        elif word == "BEGIN" and following == "CATCH":
            k = at + 2
            while k + 1 < len(own) and not (own[k].word == "END" and own[k + 1].word == "CATCH"):
                k += 1
            self.at = k + 2
        elif word in ("BEGIN", "END", "ELSE"):
            self.at = at + 1 + (following in ("TRY", "CATCH", "TRAN", "TRANSACTION"))
        elif word in ("IF", "WHILE"):
            self.until_next(at + 1)
        elif word in ("DECLARE", "SET"):
            self.declare(self.until_next(at + 1))
        elif word == "WITH":
            self.common(at + 1)
        elif word == "INSERT":
            self.insert()
        elif word == "SELECT" or (word == "(" and following in ("SELECT", "(")):
            self.select_statement(self.until_next(at + 1 if word == "SELECT" else at, {"SELECT"} if word == "(" else set()), word == "SELECT")
        elif word == "UPDATE":
            self.update(self.until_next(at + 1, {"SET"}))
        elif word == "DELETE":
            self.delete(self.until_next(at + 1))
        elif word == "MERGE":
            self.merge(self.until_next(at + 1, {"SET", "INSERT", "UPDATE", "DELETE", "SELECT", "WITH"}))
        elif word in ("EXEC", "EXECUTE"):
            self.execute(self.until_next(at + 1))
        else:
            self.until_next(at + 1)

    def declare(self, own: list[Tok]) -> None:
        for part in split(own, ","):
            if part and part[0].kind == "variable":
                k = find(part, ("=", "+="))
                if k < len(part):
                    value = self.value(part[k + 1 :])
                    old = self.values.get(part[0].text.lower(), "") if part[k].text == "+=" else ""
                    self.values[part[0].text.lower()] = old + value

    def value(self, own: list[Tok]) -> str:
        """The text that literals and known variables joined by + make; others count as empty."""
        out = []
        for part in split(own, "+"):
            if len(part) == 1 and part[0].kind == "text":
                out.append(literal(part[0]))
            elif len(part) == 1 and part[0].kind == "variable":
                out.append(self.values.get(part[0].text.lower(), part[0].text))
            elif len(part) == 1 and part[0].kind == "number":
                out.append(part[0].text)
        return "".join(out)

    def common(self, at: int) -> None:
        own = self.own
        while True:
            name = own[at].name
            k = at + 1
            columns: list[str] = []
            if own[k].word == "(":
                end = closing(own, k)
                columns = [p[0].name for p in split(own[k + 1 : end], ",") if p]
                k = end + 1
            k += own[k].word == "AS"
            end = closing(own, k)
            self.ctes.add(name.lower())
            self.query(own[k + 1 : end], "CTE", Table(table=name), columns or None)
            at = end + 1
            if at >= len(own) or own[at].word != ",":
                break
            at += 1
        self.at = at
        if at < len(own):
            self.statement()

    def insert(self) -> None:
        own, at = self.own, self.at + 1
        if own[at].word == "TOP":
            at = closing(own, at + 1) + 1
        at += own[at].word == "INTO"
        parts, at = self.name_at(own, at)
        target, columns = self.table(parts), None
        if at < len(own) and own[at].word == "WITH":
            at = closing(own, at + 1) + 1
        if at < len(own) and own[at].word == "(" and own[at + 1].word != "SELECT":
            end = closing(own, at)
            columns = [p[-1].name for p in split(own[at + 1 : end], ",") if p]
            at = end + 1
        if at < len(own) and own[at].word == "OUTPUT":
            while own[at].word not in ("SELECT", "VALUES", "EXEC", "EXECUTE", "("):
                at += 1
        if own[at].word in ("EXEC", "EXECUTE"):
            rest = self.until_next(at + 1)
            ref = procedure_reference(text_of(rest))
            if ref:
                self.add("INSERT_EXEC", Table(self.server, self.database, *ref), "*", target, "*")
            return
        if own[at].word == "WITH":
            self.at = at
            self.common(at + 1)
            return
        body = self.until_next(at, {"SELECT"}) if own[at].word in ("SELECT", "(") else self.until_next(at + 1)
        if own[at].word in ("SELECT", "("):
            self.query(body, "INSERT", target, columns)

    def select_statement(self, own: list[Tok], bare: bool) -> None:
        body = [Tok("name", "SELECT"), *own] if bare else own
        first = split(body, "UNION", "EXCEPT", "INTERSECT")[0]
        k = find(first, ("INTO",))
        items = split(first[1 : find(first, HEADS)], ",") if bare else []
        if items and all(i and i[0].kind == "variable" and len(i) > 1 and i[1].text == "=" for i in items):
            self.declare([t for n, i in enumerate(items) for t in ([Tok("sign", ",")] if n else []) + i])
            return
        if k < len(first):
            parts, end = self.name_at(first, k + 1)
            body = body[:k] + body[end:]
            self.query(body, "SELECTINTO", self.table(parts), None)
        else:
            self.query(body, "SELECT", Table(), None)

    def execute(self, own: list[Tok]) -> None:
        if own and own[0].word == "(":
            inner = own[1 : closing(own, 0)]
            self.dynamic(self.value(inner))
            return
        ref = procedure_reference(text_of(own))
        if ref and ref[1].lower() == "sp_executesql":
            k = next(n for n, t in enumerate(own) if t.name.lower() == "sp_executesql")
            self.dynamic(self.value(split(own[k + 1 :], ",")[0]))
        elif ref:
            called = Table(self.server, self.database, *ref)
            self.add("EXECUTE_PROC", called, "", called, "")

    def dynamic(self, sql: str) -> None:
        """Statements in a text; variables without a value become DUMMY."""
        if sql.strip() and self.depth < 5:
            inner = Reader(self.database, self.server, self.values, self.depth + 1)
            inner.procedure, inner.ctes = self.procedure, set(self.ctes)
            for r in inner.read(re.sub(r"@\w+", "DUMMY", sql)):
                if r not in self.records:
                    self.records.append(r)

    # queries

    def query(self, own: list[Tok], operation: str, target: Table, columns: list[str] | None, outer: Scope | None = None) -> list[str]:
        """Records of a query into target; gives the names of its columns."""
        parts = split(own, "UNION", "EXCEPT", "INTERSECT")
        names: list[str] = []
        for part in parts:
            while part and part[0].word in ("ALL", "DISTINCT"):
                part = part[1:]
            while part and part[0].word == "(" and closing(part, 0) >= len(part) - 1:
                part = part[1 : closing(part, 0)]
            if len(split(part, "UNION", "EXCEPT", "INTERSECT")) > 1:
                got = self.query(part, operation, target, columns or (names or None), outer)
            elif part and part[0].word == "SELECT":
                got = self.simple(part[1:], operation, target, columns or (names or None), outer)
            else:
                continue
            names = names or got
        return names

    def simple(self, own: list[Tok], operation: str, target: Table, columns: list[str] | None, outer: Scope | None) -> list[str]:
        at = 0
        while at < len(own) and own[at].word in ("DISTINCT", "ALL", "TOP", "PERCENT", "WITH", "TIES"):
            if own[at].word == "TOP":
                at = closing(own, at + 1) + 1 if own[at + 1].word == "(" else at + 2
            else:
                at += 1
        listed = own[at : find(own, HEADS, at)]
        scope = Scope(outer=outer)
        f = find(own, ("FROM",), at)
        if f < len(own):
            self.sources(own[f + 1 : find(own, ("WHERE", "GROUP", "HAVING", "ORDER", "OPTION", "FOR"), f + 1)], scope, operation, target)
        w = find(own, ("WHERE",), at)
        where = text_of(own[w + 1 : find(own, ("GROUP", "HAVING", "ORDER", "OPTION", "FOR"), w + 1)]) if w < len(own) else ""
        joins = "; ".join(scope.joins)
        names: list[str] = []
        for n, item in enumerate(split(listed, ",")):
            expression, alias = self.alias(item)
            into = columns[n] if columns and n < len(columns) else alias
            names.append(alias)
            if expression and expression[-1].text == "*" and (len(expression) == 1 or expression[-2].text == "."):
                chosen = [scope.tables.get(expression[-3].name.lower())] if len(expression) > 2 else list(dict.fromkeys(scope.tables.values()))
                for t in chosen:
                    if t:
                        self.add(operation, t, "*", target, "*", "", joins, where)
                continue
            found = self.columns(expression, scope)
            shown = text_of(expression) if len(expression) > 1 else ""
            for source, column in found:
                self.add(operation, source, column, target, into or column, shown, joins, where)
                names[-1] = names[-1] or column
            if not found and expression and not scope.opaque:
                self.add(operation, Table(), "", target, into, text_of(expression), joins, where)
        return names

    def alias(self, item: list[Tok]) -> tuple[list[Tok], str]:
        """An item of a select list without its name, and the name."""
        if len(item) > 2 and item[0].kind in ("name", "variable") and item[1].text == "=":
            return item[2:], item[0].name
        if len(item) > 2 and item[-2].word == "AS":
            return item[:-2], literal(item[-1]) if item[-1].kind == "text" else item[-1].name
        if len(item) > 1 and item[-1].kind == "name" and item[-1].word not in WORDS and item[-2].text not in (".",) and (item[-2].kind in ("name", "number", "text", "variable") or item[-2].text == ")"):
            return item[:-1], item[-1].name
        simple = item and item[-1].kind == "name" and all(t.kind == "name" or t.text == "." for t in item)
        return item, item[-1].name if simple else ""

    def sources(self, own: list[Tok], scope: Scope, operation: str, target: Table) -> None:
        at, kind = 0, ""
        while at < len(own):
            w = own[at].word
            if w == ",":
                at, kind = at + 1, ""
                continue
            if w in JOINS or w == "APPLY":
                words = []
                while at < len(own) and own[at].word in JOINS | {"APPLY", "HASH", "LOOP"}:
                    words.append(own[at].word)
                    at += 1
                kind = " ".join(words)
                continue
            begin = at
            at = self.source(own, at, scope, operation, target)
            named = text_of(own[begin:at])
            if at < len(own) and own[at].word == "ON":
                end = at + 1
                depth = 0
                while end < len(own) and not (depth == 0 and (own[end].word in JOINS or own[end].word == ",")):
                    depth += (own[end].word == "(") - (own[end].word == ")")
                    end += 1
                side = {"LEFT": "LeftOuter", "RIGHT": "RightOuter", "FULL": "FullOuter"}.get(kind.split(" ")[0] if kind else "", "Inner")
                scope.joins.append(f"{side}: {text_of(own[at + 1 : end])}")
                at = end
            elif kind in ("CROSS JOIN", "CROSS APPLY", "OUTER APPLY"):
                scope.joins.append(f"{kind}: {named}")
            if at == begin:
                at += 1

    def source(self, own: list[Tok], at: int, scope: Scope, operation: str, target: Table) -> int:
        made: Table | None
        if own[at].word == "(":
            end = closing(own, at)
            inner, name = own[at + 1 : end], ""
            at = end + 1
            at += at < len(own) and own[at].word == "AS"
            if at < len(own) and own[at].kind == "name" and own[at].word not in WORDS:
                name, at = own[at].name, at + 1
            if inner and inner[0].word in ("SELECT", "("):
                columns = None
                if at < len(own) and own[at].word == "(":
                    stop = closing(own, at)
                    columns, at = [p[0].name for p in split(own[at + 1 : stop], ",") if p], stop + 1
                self.query(inner, "DERIVED", Table(table=name), columns, scope)
            if name:
                scope.tables[name.lower()] = Table(table=name)
            return at
        if own[at].kind != "name":
            return at
        if own[at].word in ("OPENQUERY", "OPENROWSET"):
            end = closing(own, at + 1)
            args = split(own[at + 2 : end], ",")
            remote = args[0][0].name if own[at].word == "OPENQUERY" else ""
            sql = literal(args[-1][0]) if args[-1] and args[-1][0].kind == "text" else self.value(args[-1])
            inner = Reader("", remote, self.values, self.depth + 1)
            inner.procedure = self.procedure
            if self.depth < 5:
                body = tokenize(re.sub(r"@\w+", "DUMMY", sql))
                inner.query(body, operation, target, None)
                self.records += [r for r in inner.records if r not in self.records]
            made, at, scope.opaque = None, end + 1, True
        else:
            parts, at = self.name_at(own, at)
            made = self.table(parts)
            scope.tables.setdefault(parts[-1].lower(), made)
            if at < len(own) and own[at].word == "(":
                at = closing(own, at) + 1
        at += at < len(own) and own[at].word == "AS"
        if at < len(own) and own[at].kind == "name" and own[at].word not in WORDS | STARTS:
            if made:
                scope.tables.pop(made.table.lower(), None)
            scope.tables[own[at].name.lower()] = made
            at += 1
        while at + 1 < len(own) and own[at].word == "WITH" and own[at + 1].word == "(":
            at = closing(own, at + 1) + 1
        return at

    def columns(self, own: list[Tok], scope: Scope) -> list[tuple[Table, str]]:
        """The columns that an expression reads, each once, in order."""
        out: list[tuple[Table, str]] = []
        at = 0
        while at < len(own):
            t = own[at]
            if t.word == "(" and at + 1 < len(own) and own[at + 1].word == "SELECT":
                end = closing(own, at)
                inner = own[at + 2 : end]
                nested = Scope(outer=scope)
                f = find(inner, ("FROM",))
                if f < len(inner):
                    self.sources(inner[f + 1 : find(inner, ("WHERE", "GROUP", "HAVING", "ORDER"), f + 1)], nested, "SUBQUERY", Table())
                self.records = [r for r in self.records if r["operation_type"] != "SUBQUERY"]
                out += self.columns(inner[: find(inner, HEADS)], nested)
                at = end + 1
                continue
            if t.kind != "name" or t.word in WORDS | STARTS:
                at += 1
                continue
            parts, end = self.name_at(own, at)
            if end < len(own) and own[end].word == "(":
                at = end
                continue
            if not (at and own[at - 1].word == "AS"):
                out += self.resolve(parts, scope)
            at = end
        return list(dict.fromkeys(out))

    def resolve(self, parts: list[str], scope: Scope | None) -> list[tuple[Table, str]]:
        """Where a column comes from; of several tables a list 'A | B'."""
        column = parts[-1]
        if len(parts) > 1:
            here = scope
            while here:
                if parts[-2].lower() in here.tables:
                    found = here.tables[parts[-2].lower()]
                    return [(found, column)] if found else []
                here = here.outer
            return [(self.table(parts[:-1]), column)]
        known = [t for t in dict.fromkeys(scope.tables.values()) if t] if scope else []
        if not known:
            return self.resolve(parts, scope.outer) if scope and scope.outer else []
        if len(known) == 1:
            return [(known[0], column)]
        return [(replace(known[0], table=" | ".join(t.table for t in known)), column)]

    def update(self, own: list[Tok]) -> None:
        s = find(own, ("SET",))
        name, _ = self.name_at(own, closing(own, 1) + 1 if own[0].word == "TOP" else 0)
        f, w = find(own, ("FROM",), s), find(own, ("WHERE",), s)
        scope = Scope()
        if f < len(own):
            self.sources(own[f + 1 : find(own, ("WHERE", "OPTION"), f + 1)], scope, "UPDATE", Table())
        target = scope.tables.get(name[-1].lower()) if len(name) == 1 else None
        target = target or self.table(name)
        if not scope.tables:
            scope.tables[name[-1].lower()] = target
        self.sets(own[s + 1 : min(f, w, find(own, ("OUTPUT", "OPTION"), s))], "UPDATE", scope, target, "; ".join(scope.joins), text_of(own[w + 1 :]) if w < len(own) else "")

    def sets(self, own: list[Tok], operation: str, scope: Scope, target: Table, joins: str, where: str) -> None:
        for part in split(own, ","):
            k = find(part, ("=", "+=", "-=", "*=", "/="))
            if 0 < k < len(part) and part[k - 1].kind == "name":
                for source, column in self.columns(part[k + 1 :], scope):
                    self.add(operation, source, column, target, part[k - 1].name, text_of(part[k + 1 :]), joins, where)

    def delete(self, own: list[Tok]) -> None:
        at = closing(own, 1) + 1 if own[0].word == "TOP" else 0
        at += own[at].word == "FROM"
        name, at = self.name_at(own, at)
        scope = Scope()
        f, w = find(own, ("FROM",), at), find(own, ("WHERE",), at)
        if f < len(own):
            self.sources(own[f + 1 : find(own, ("WHERE", "OPTION"), f + 1)], scope, "DELETE", Table())
        target = (scope.tables.get(name[-1].lower()) if len(name) == 1 else None) or self.table(name)
        self.add("DELETE", target, "", target, "", "", "; ".join(scope.joins), text_of(own[w + 1 :]) if w < len(own) else "")

    def merge(self, own: list[Tok]) -> None:
        at = int(own[0].word == "INTO")
        name, at = self.name_at(own, at)
        target, scope = self.table(name), Scope()
        u = find(own, ("USING",), at)
        for t in own[at:u]:
            if t.kind == "name" and t.word not in WORDS | {"HOLDLOCK"}:
                scope.tables[t.name.lower()] = target
        scope.tables.setdefault(name[-1].lower(), target)
        o = find(own, ("ON",), u)
        using = Scope()
        self.merge_source(own[u + 1 : o], using)
        scope.tables = {**using.tables, **{k: v for k, v in scope.tables.items()}}
        m = find(own, ("WHEN",), o)
        on = text_of(own[o + 1 : m])
        while m < len(own):
            end = find(own, ("WHEN",), m + 1)
            branch = own[m:end]
            then = find(branch, ("THEN",))
            action = branch[then + 1 :]
            if action and action[0].word == "UPDATE":
                k = find(action, ("SET",))
                self.sets(action[k + 1 : find(action, ("OUTPUT", "OPTION"), k)], "MERGE-UPDATE", replace(using, outer=scope) if len(using.tables) == 1 else scope, target, on, "")
            elif action and action[0].word == "INSERT":
                columns: list[str] = []
                k = 1
                if action[k].word == "(":
                    stop = closing(action, k)
                    columns, k = [p[-1].name for p in split(action[k + 1 : stop], ",") if p], stop + 1
                k = find(action, ("VALUES",), k)
                if k < len(action):
                    for n, value in enumerate(split(action[k + 2 : closing(action, k + 1)], ",")):
                        for source, column in self.columns(value, replace(using, outer=scope)):
                            self.add("MERGE-INSERT", source, column, target, columns[n] if n < len(columns) else column, text_of(value) if len(value) > 1 else "", on, "")
            m = end

    def merge_source(self, own: list[Tok], scope: Scope) -> None:
        if own and own[0].word == "(":
            end = closing(own, 0)
            rest = [t for t in own[end + 1 :] if t.word != "AS"]
            name = rest[0].name if rest else "source"
            self.query(own[1:end], "MERGE-SOURCE", Table(table=name), None)
            scope.tables[name.lower()] = Table(table=name)
        else:
            self.source(own, 0, scope, "MERGE", Table())


def parse(sql: str, database: str = "", server: str = "", variables: dict[str, str] | None = None) -> list[dict[str, str]]:
    """Lineage records of a script; an empty or null one has none."""
    return Reader(database, server, variables).read(positional(sql or ""))


def lineage_records(scripts: DataFrame, keys: list[str], sql: str) -> DataFrame:
    """keys and the lineage records of each script of a column of SQL texts."""
    kept = scripts.select(*keys, sql)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    names = [p.strip().split(" ")[0] for p in SCHEMA.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(*row[:-1], *[r[n] for n in names]) for row in frame.itertuples(index=False) for r in parse(row[-1])]
            yield pd.DataFrame(out, columns=[*keys, *names])

    return kept.mapInPandas(run, f"{fields}, {SCHEMA}")
