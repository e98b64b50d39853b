"""Compiler from the data-flow expression language to Spark columns.

A real parser instead of rewriting text: ternaries, casts and function calls nest to any depth. Types
are followed only as far as '+' needs them, which joins texts and adds numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, StringType, StructType, TimestampType

# The language's types and what they are in Spark.
TYPES = {
    "DT_WSTR": "string", "DT_STR": "string", "DT_NTEXT": "string", "DT_TEXT": "string", "DT_GUID": "string", "DT_I1": "tinyint", "DT_I2": "smallint", "DT_I4": "int", "DT_I8": "bigint",
    "DT_UI1": "smallint", "DT_UI2": "int", "DT_UI4": "bigint", "DT_UI8": "decimal(20,0)", "DT_R4": "float", "DT_R8": "double", "DT_CY": "decimal(19,4)", "DT_BOOL": "boolean", "DT_BYTES": "binary",
    "DT_DATE": "timestamp", "DT_DBDATE": "date", "DT_DBTIMESTAMP": "timestamp", "DT_DBTIMESTAMP2": "timestamp", "DT_FILETIME": "timestamp", "DT_DBTIMESTAMPOFFSET": "timestamp",
}
TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<text>\"(?:\\.|[^\"\\])*\")|(?P<variable>@\[[^\]]+\])|(?P<column>\[[^\]]+\])"
    r"|(?P<name>[A-Za-z_#][\w#$.]*)|(?P<sign>\|\||&&|==|!=|<=|>=|[-+*/%<>!?:(),]))"
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


class ExpressionError(ValueError):
    """An expression that can't be compiled."""


@dataclass
class Typed:
    """A column and what is known of its type: 'text', 'number', 'flag', 'time' or ''."""

    column: Column
    kind: str = ""


def tokens(source: str) -> list[tuple[str, str]]:
    """(kind, text) of the tokens of an expression."""
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        found = TOKEN.match(source, at)
        if not found:
            raise ExpressionError(f"unexpected {source[at:at + 10]!r} at {at} in {source!r}")
        out.append((found.lastgroup or "", found[found.lastgroup or 0]))
        at = found.end()
    return out


def to_type(column: Column, name: str, sizes: list[int], parity: bool = False) -> Typed:
    """column cast to a type of the language; null where a value can't be. Texts are cut to their size."""
    kind = name.upper()
    if kind in ("DT_NUMERIC", "DT_DECIMAL"):
        precision, scale = (sizes + [18, 0])[:2] if kind == "DT_NUMERIC" else (28, (sizes + [0])[0])
        spark, family = f"decimal({precision},{scale})", "number"
    elif kind in TYPES:
        spark = TYPES[kind]
        family = "text" if spark == "string" else "flag" if spark == "boolean" else "time" if spark in ("date", "timestamp") else "number"
    else:
        raise ExpressionError(f"unknown type {name}")
    if parity:
        return Typed(column, family)
    made = column.cast("string") if spark == "string" else column.try_cast(spark)
    return Typed(F.substring(made, 1, sizes[0]) if spark == "string" and sizes and kind != "DT_GUID" else made, family)


class Compiler:
    """Compiles expressions over the columns of a schema.

    variables gives values for @[Namespace::Name]. With parity casts are only read, not done.
    """

    def __init__(self, schema: StructType, variables: dict[str, object] | None = None, parity: bool = False) -> None:
        self.kinds = {f.name.lower(): (f.name, "text" if isinstance(f.dataType, StringType) else "flag" if isinstance(f.dataType, BooleanType) else "time" if isinstance(f.dataType, (DateType, TimestampType)) else "number") for f in schema.fields}
        self.variables = {k.lower(): v for k, v in (variables or {}).items()}
        self.parity = parity

    def compile(self, source: str) -> Column:
        """The column of an expression."""
        return self.typed(source).column

    def typed(self, source: str) -> Typed:
        self.own, self.at = tokens(source), 0
        made = self.ternary()
        if self.at < len(self.own):
            raise ExpressionError(f"unexpected {self.own[self.at][1]!r} in {source!r}")
        return made

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.own) and self.own[self.at][1] in texts and self.own[self.at][0] == "sign"

    def take(self, text: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.own) or text is not None and self.own[self.at][1] != text:
            raise ExpressionError(f"expected {text or 'more'} after {' '.join(t for _, t in self.own[:self.at])!r}")
        self.at += 1
        return self.own[self.at - 1]

    def ternary(self) -> Typed:
        test = self.binary(0)
        if not self.peek("?"):
            return test
        self.take("?")
        yes = self.ternary()
        self.take(":")
        no = self.ternary()
        return Typed(F.when(test.column, yes.column).otherwise(no.column), yes.kind or no.kind)

    LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))

    def binary(self, level: int) -> Typed:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek(*self.LEVELS[level]):
            sign = self.take()[1]
            left = self.combine(sign, left, self.binary(level + 1))
        return left

    def combine(self, sign: str, a: Typed, b: Typed) -> Typed:
        x, y = a.column, b.column
        if sign == "+" and "text" in (a.kind, b.kind):
            return Typed(F.concat(x.cast("string"), y.cast("string")), "text")
        flags: dict[str, Callable[[], Column]] = {"||": lambda: x | y, "&&": lambda: x & y, "==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}
        if sign in flags:
            return Typed(flags[sign](), "flag")
        numbers: dict[str, Callable[[], Column]] = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y)}
        return Typed(numbers[sign](), a.kind or b.kind)

    def unary(self) -> Typed:
        if self.peek("!"):
            self.take()
            return Typed(~self.unary().column, "flag")
        if self.peek("-"):
            self.take()
            return Typed(-self.unary().column, "number")
        if self.peek("(") and self.at + 1 < len(self.own) and self.own[self.at + 1][1].upper().startswith("DT_"):
            name, sizes = self.type_name()
            return to_type(self.unary().column, name, sizes, self.parity)
        return self.primary()

    def type_name(self) -> tuple[str, list[int]]:
        self.take("(")
        name, sizes = self.take()[1], []
        while self.peek(","):
            self.take()
            sizes.append(int(self.take()[1]))
        self.take(")")
        return name, sizes

    def primary(self) -> Typed:
        kind, text = self.take()
        if kind == "number":
            return Typed(F.lit(float(text) if re.search(r"[.eE]", text) else int(text)), "number")
        if kind == "text":
            return Typed(F.lit(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1])), "text")
        if kind == "variable":
            return self.variable(text[2:-1])
        if kind == "column":
            return self.column(text[1:-1])
        if text == "(":
            inner = self.ternary()
            self.take(")")
            return inner
        if kind == "name" and self.peek("("):
            return self.call(text.upper())
        if kind == "name":
            low = text.lower()
            return Typed(F.lit(low == "true"), "flag") if low in ("true", "false") and low not in self.kinds else self.column(text)
        raise ExpressionError(f"unexpected {text!r}")

    def column(self, name: str) -> Typed:
        got = self.kinds.get(name.lower())
        if not got:
            raise ExpressionError(f"unknown column {name}")
        return Typed(F.col(f"`{got[0]}`"), got[1])

    def variable(self, name: str) -> Typed:
        key = name.lower().lstrip("$")
        for k in (name.lower(), key, key.split("::")[-1]):
            if k in self.variables:
                value = self.variables[k]
                return Typed(F.lit(value), "text" if isinstance(value, str) else "flag" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "time")
        raise ExpressionError(f"unknown variable {name}")

    def call(self, name: str) -> Typed:
        if name == "NULL":
            self.take("(")
            self.at -= 1
            kind, sizes = self.type_name()
            return to_type(F.lit(None), kind, sizes)
        self.take("(")
        args: list[Typed] = []
        while not self.peek(")"):
            args.append(self.ternary())
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        if name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {name}")
        kind, made = FUNCTIONS[name]
        return Typed(made(*[a.column for a in args]), kind or (args[0].kind if args else ""))


def _nth(text: Column, part: Column, n: Column) -> Column:
    """Where part occurs in text for the n-th time, counted from 1; 0 where it doesn't."""
    before = F.substring_index(text, part, n) if isinstance(part, str) else F.call_function("substring_index", text, part, n)
    count = (F.length(text) - F.length(F.replace(text, part))) / F.length(part)
    return F.when(count >= n, F.length(before) + 1).otherwise(0).cast("int")


def _unit(part: Column) -> Column:
    return F.lower(part)


def _date_add(part: Column, n: Column, day: Column) -> Column:
    time, unit = day.cast("timestamp"), _unit(part)
    step = lambda **k: time + F.make_interval(**k)
    return (
        F.when(unit.isin("year", "yyyy", "yy"), F.add_months(time, n * 12).cast("timestamp")).when(unit.isin("month", "mm", "m"), F.add_months(time, n).cast("timestamp"))
        .when(unit.isin("day", "dd", "d"), step(days=n)).when(unit.isin("hour", "hh"), step(hours=n)).when(unit.isin("minute", "mi", "n"), step(mins=n))
    )


def _date_diff(part: Column, a: Column, b: Column) -> Column:
    unit, x, y = _unit(part), a.cast("timestamp"), b.cast("timestamp")
    months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
    return F.when(unit.isin("year", "yyyy", "yy"), F.year(y) - F.year(x)).when(unit.isin("month", "mm", "m"), months).when(unit.isin("day", "dd", "d"), F.datediff(y, x)).when(unit.isin("hour", "hh"), F.timestamp_diff("HOUR", F.date_trunc("hour", x), F.date_trunc("hour", y)).cast("int"))


def _date_part(part: Column, day: Column) -> Column:
    unit = _unit(part)
    return F.when(unit.isin("year", "yyyy", "yy"), F.year(day)).when(unit.isin("month", "mm", "m"), F.month(day)).when(unit.isin("day", "dd", "d"), F.dayofmonth(day)).when(unit.isin("quarter", "qq", "q"), F.quarter(day)).when(unit.isin("hour", "hh"), F.hour(day))


FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "ISNULL": ("flag", lambda x: x.isNull()),
    "REPLACENULL": ("", lambda x, y: F.coalesce(x, y)),
    "TRIM": ("text", F.trim), "LTRIM": ("text", F.ltrim), "RTRIM": ("text", F.rtrim), "UPPER": ("text", F.upper), "LOWER": ("text", F.lower), "REVERSE": ("text", F.reverse),
    "LEN": ("number", F.length), "LEFT": ("text", lambda x, n: F.left(x, n)), "RIGHT": ("text", lambda x, n: F.right(x, n)), "REPLICATE": ("text", lambda x, n: F.call_function("repeat", x, n)),
    "SUBSTRING": ("text", lambda x, a, n: F.substring(x, a, n)),
    "REPLACE": ("text", lambda x, a, b: F.replace(x, a, b)),
    "FINDSTRING": ("number", _nth),
    "TOKEN": ("text", lambda x, d, n: F.try_element_at(F.filter(F.split(x, F.concat(F.lit("["), d, F.lit("]"))), lambda p: p != ""), n)),
    "TOKENCOUNT": ("number", lambda x, d: F.size(F.filter(F.split(x, F.concat(F.lit("["), d, F.lit("]"))), lambda p: p != ""))),
    "CODEPOINT": ("number", F.ascii), "HEX": ("text", F.hex),
    "ABS": ("number", F.abs), "CEILING": ("number", F.ceil), "FLOOR": ("number", F.floor), "ROUND": ("number", lambda x, n: F.call_function("round", x, n)), "SIGN": ("number", F.sign), "SQRT": ("number", F.sqrt),
    "SQUARE": ("number", lambda x: x * x), "EXP": ("number", F.exp), "LN": ("number", F.log), "LOG": ("number", F.log10), "POWER": ("number", lambda x, y: F.pow(x, y)),
    "GETDATE": ("time", F.current_timestamp), "GETUTCDATE": ("time", F.current_timestamp), "YEAR": ("number", F.year), "MONTH": ("number", F.month), "DAY": ("number", F.dayofmonth),
    "DATEADD": ("time", _date_add), "DATEDIFF": ("number", _date_diff), "DATEPART": ("number", _date_part),
}


def substitute(source: str, variables: dict[str, str]) -> str:
    """The value of a variable expression: references and quoted texts joined by '+'.

    Only a '+' outside of quotes joins. A reference without a value stays as it is written.
    """
    known = {k.lower(): v for k, v in variables.items()}
    parts = re.findall(r"\"(?:\\.|[^\"\\])*\"|@\[[^\]]+\]|\+|[^+\"@]+|@", source)
    out = []
    for part in parts:
        if part.startswith('"'):
            out.append(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), part[1:-1]))
        elif part.startswith("@["):
            name = part[2:-1].lstrip("$").lower()
            out.append(str(known.get(name, known.get(name.split("::")[-1], part))))
        elif part != "+" and part.strip():
            out.append(part.strip())
    return "".join(out)
