"""Syntax trees to Spark columns.

A dotted path is a column by its last part. A single quoted name is a column if the schema has
it and text otherwise; a bare name is a parameter, NULL, a column, or an error. Literals take the
type of what they are compared with, so ANSI mode never casts data. A NULL condition doesn't take
its branch. Division is try_divide, conversions are try_cast, CONCAT skips NULL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .syntax import Arithmetic, Between, Call, Compare, FormulaError, Group, If, Logic, Member, Negative, Node, Not, Number, Reference, parse

#: Fixed values of the language: date formats, units and type names.
DATE_FORMATS = {"DD/MM/YYYY": "dd/MM/yyyy", "MM/DD/YYYY": "MM/dd/yyyy", "YYYY-MM-DD": "yyyy-MM-dd", "DD-MM-YYYY": "dd-MM-yyyy", "MM-DD-YYYY": "MM-dd-yyyy"}
UNITS = {"D": "DAY", "DAY": "DAY", "DAYS": "DAY", "M": "MONTH", "MONTH": "MONTH", "Y": "YEAR", "YEAR": "YEAR", "H": "HOUR", "HOUR": "HOUR", "MI": "MINUTE", "MINUTE": "MINUTE", "S": "SECOND", "SECOND": "SECOND", "Q": "QUARTER", "QUARTER": "QUARTER", "W": "WEEK", "WEEK": "WEEK"}
TYPES = {"NUMBER": "decimal(38,10)", "DECIMAL": "decimal(38,10)", "INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "DATE": "date", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}

#: Which argument of a function is a word of the language, even if the schema has that name.
WORDS = {"DATEDIFF": 2, "DATEPART": 1, "CONVERT": 1, "TODATE": 1, "DATE": 1, "PERIOD": 0}


@dataclass(frozen=True)
class Value:
    column: Column
    type: str  # number, text, date, time, bool, null
    literal: object = None


@dataclass
class Scope:
    """What names mean: the schema, bound parameters, the business date, and flags that stand for hierarchy tests."""

    schema: T.StructType
    parameters: Mapping[str, object] = field(default_factory=dict)
    business_date: dt.date | None = None
    entities: frozenset[str] = frozenset()
    fiscal_month: int = 4
    flags: dict[Node, str] = field(default_factory=dict)
    frame: DataFrame | None = None

    def __post_init__(self):
        self.columns = {f.name.lower(): f for f in self.schema.fields}
        self.parameters = {k.lower(): v for k, v in self.parameters.items()}


def _kind(t: T.DataType) -> str:
    for kind, types in (("number", T.NumericType), ("text", (T.StringType, T.CharType, T.VarcharType)), ("date", T.DateType), ("time", (T.TimestampType, T.TimestampNTZType)), ("bool", T.BooleanType), ("null", T.NullType)):
        if isinstance(t, types):
            return kind
    return "other"


def literal(x: object) -> Value:
    if x is None:
        return Value(F.lit(None), "null")
    kind = "bool" if isinstance(x, bool) else "number" if isinstance(x, int | float | Decimal) else "time" if isinstance(x, dt.datetime) else "date" if isinstance(x, dt.date) else "text"
    return Value(F.lit(x), kind, x)


def _as(v: Value, kind: str) -> Column:
    """A value as a kind; only literals and text change in meaning."""
    if v.type == kind or v.type == "null":
        return v.column
    if kind == "text":
        return v.column.cast("string")
    if kind == "date":
        return v.column.cast("date") if v.type == "time" else v.column.try_cast("date")
    if kind == "number":
        if v.literal is not None:
            try:
                d = Decimal(str(v.literal))
                return F.lit(int(d) if d == d.to_integral_value() else d)
            except ArithmeticError:
                return F.lit(None).cast("bigint")
        return v.column.try_cast("double")
    return v.column


def _aligned(a: Value, b: Value) -> tuple[Column, Column]:
    """Two values of one kind, the literal following the data."""
    if a.type == b.type or "null" in (a.type, b.type):
        return a.column, b.column
    if {a.type, b.type} == {"date", "time"}:
        return _as(a, "date"), _as(b, "date")
    kind = (b if a.literal is not None else a).type
    kind = "date" if kind == "time" else kind
    return _as(a, kind), _as(b, kind)


class Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope

    def value(self, node: Node) -> Value:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def condition(self, node: Node) -> Column:
        v = self.value(node)
        return v.column if v.type in ("bool", "null") else v.column.try_cast("boolean")

    def _group(self, n: Group) -> Value:
        return self.value(n.arg)

    def _number(self, n: Number) -> Value:
        return literal(n.value)

    def _reference(self, n: Reference) -> Value:
        s, last = self.scope, n.parts[-1].lower()
        if len(n.parts) >= 2 and last == "business_date" and n.parts[-2].lower() == "var":
            if s.business_date is None:
                raise FormulaError("no business date is bound", n.span[0])
            return literal(s.business_date)
        if len(n.parts) == 1 and not n.quoted[0]:
            if last in s.parameters:
                return literal(s.parameters[last])
            if last == "null":
                return literal(None)
        if len(n.parts) == 1 and n.quoted[0] and last in s.parameters and last not in s.columns:
            return literal(s.parameters[last])
        if len(n.parts) > 1 and s.entities and n.parts[0].upper() not in s.entities:
            raise FormulaError(f"unknown entity {n.parts[0]}", n.span[0])
        if f := s.columns.get(last):
            return Value(F.col(f"`{f.name}`"), _kind(f.dataType))
        if n.maybe_text:
            return literal(n.parts[0])
        raise FormulaError(f"unknown name {'.'.join(n.parts)}", n.span[0])

    def _if(self, n: If) -> Value:
        values = [self.value(v) for _, v in n.branches] + ([self.value(n.otherwise)] if n.otherwise else [])
        kinds = {v.type for v in values} - {"null"}
        kind = kinds.pop() if len(kinds) == 1 else "date" if kinds and kinds <= {"date", "time"} else "text" if kinds else "null"
        out = None
        for (c, _), v in zip(n.branches, values):
            out = (F if out is None else out).when(self.condition(c), _as(v, kind))
        return Value(out.otherwise(_as(values[-1], kind)) if n.otherwise else out, kind)

    def _logic(self, n: Logic) -> Value:
        return Value(reduce((lambda a, b: a & b) if n.op == "AND" else (lambda a, b: a | b), map(self.condition, n.args)), "bool")

    def _not(self, n: Not) -> Value:
        return Value(~self.condition(n.arg), "bool")

    def _compare(self, n: Compare) -> Value:
        a, b = _aligned(self.value(n.left), self.value(n.right))
        return Value({"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[n.op], "bool")

    def _between(self, n: Between) -> Value:
        x = self.value(n.arg)
        low, high = (_aligned(x, self.value(v)) for v in (n.low, n.high))
        return Value((low[0] >= low[1]) & (high[0] <= high[1]), "bool")

    def _member(self, n: Member) -> Value:
        if n in self.scope.flags:
            flag = F.coalesce(F.col(self.scope.flags[n]), F.lit(False))
            return Value(flag if n.op == "HRCHYIN" else ~flag, "bool")
        x = self.value(n.left)
        if n.op in ("IN", "NOTIN"):
            kind = "date" if x.type == "time" else x.type
            hit = _as(x, kind).isin(*(_as(literal(v), kind) for v in n.values))
            return Value(hit if n.op == "IN" else ~hit, "bool")
        if n.op.startswith("HRCHY"):
            raise FormulaError("a hierarchy is needed; use derive()", n.span[0])
        text = _as(x, "text")
        test: Callable[[str], Column] = {"BEGINSWITH": text.startswith, "ENDSWITH": text.endswith}.get(n.op, text.contains)
        hit = reduce(lambda a, b: a | b, (test(str(v)) for v in n.values))
        return Value(~hit if n.op == "DOESNOTCONTAINS" else hit, "bool")

    def _arithmetic(self, n: Arithmetic) -> Value:
        a, b = self.value(n.left), self.value(n.right)
        if a.type in ("date", "time") and n.op in "+-":
            if b.type in ("date", "time"):
                return Value(F.datediff(_as(a, "date"), _as(b, "date")), "number")
            by = _as(b, "number").cast("int")
            return Value(F.date_add(_as(a, "date"), by if n.op == "+" else -by), "date")
        x, y = _as(a, "number"), _as(b, "number")
        return Value(F.try_divide(x, y) if n.op == "/" else {"+": x + y, "-": x - y, "*": x * y}[n.op], "number")

    def _negative(self, n: Negative) -> Value:
        return Value(-_as(self.value(n.arg), "number"), "number")

    def _call(self, n: Call) -> Value:
        if not (make := getattr(self, f"fn_{n.name.lower()}", None)):
            raise FormulaError(f"unknown function {n.name}", n.span[0])
        words = WORDS.get(n.name)
        args = [literal(a.parts[0]) if i == words and isinstance(a, Reference) and len(a.parts) == 1 else self.value(a) for i, a in enumerate(n.args)]
        try:
            return make(*args)
        except TypeError as e:
            raise FormulaError(f"{n.name}: wrong number of arguments ({len(n.args)})", n.span[0]) from e

    def fn_isempty(self, x: Value) -> Value:
        return Value(x.column.isNull() | (x.column == "") if x.type == "text" else x.column.isNull(), "bool")

    def fn_isnotempty(self, x: Value) -> Value:
        return Value(~self.fn_isempty(x).column, "bool")

    def _extreme(self, f, x: Value, by: tuple[Value, ...]) -> Value:
        if not by and self.scope.frame is not None:  # one aggregate over all rows, not a window in one task
            return Value(self.scope.frame.agg(f(x.column).alias("x")).scalar(), x.type)
        return Value(f(x.column).over(Window.partitionBy(*(b.column for b in by))), x.type)

    def fn_max(self, x: Value, *by: Value) -> Value:
        return self._extreme(F.max, x, by)

    def fn_min(self, x: Value, *by: Value) -> Value:
        return self._extreme(F.min, x, by)

    def fn_coalesce(self, first: Value, *rest: Value) -> Value:
        kind = next((v.type for v in (first, *rest) if v.type != "null"), "null")
        kind = "date" if kind == "time" else kind
        return Value(F.coalesce(*(_as(v, kind) for v in (first, *rest))), kind)

    def fn_substr(self, x: Value, start: Value, n: Value | None = None) -> Value:
        return Value(F.substr(_as(x, "text"), _as(start, "number").cast("int"), (_as(n, "number") if n else F.lit(2**31 - 1)).cast("int")), "text")

    def fn_lower(self, x: Value) -> Value:
        return Value(F.lower(_as(x, "text")), "text")

    def fn_upper(self, x: Value) -> Value:
        return Value(F.upper(_as(x, "text")), "text")

    def fn_len(self, x: Value) -> Value:
        return Value(F.length(_as(x, "text")), "number")

    def fn_trim(self, x: Value) -> Value:
        return Value(F.trim(_as(x, "text")), "text")

    def fn_concat(self, *x: Value) -> Value:
        return Value(F.concat_ws("", *(_as(v, "text") for v in x)), "text")

    def fn_replace(self, x: Value, old: Value, new: Value) -> Value:
        return Value(F.replace(_as(x, "text"), _as(old, "text"), _as(new, "text")), "text")

    def fn_regex(self, x: Value, pattern: Value) -> Value:
        return Value(F.rlike(_as(x, "text"), _as(pattern, "text")), "bool")

    def fn_convert(self, x: Value, to: Value) -> Value:
        name = str(to.literal).upper()
        if name not in TYPES:
            raise FormulaError(f"unknown type {to.literal}", 0)
        kind = {"s": "text", "t": "time", "b": "number"}.get(TYPES[name][0], "number")
        kind = {"date": "date", "boolean": "bool", "bigint": "number", "timestamp_ntz": "time"}.get(TYPES[name], kind)
        return Value(x.column.try_cast(TYPES[name]), kind)

    def _date(self, make) -> Value:
        return Value(make, "date")

    def fn_som(self, d: Value) -> Value:
        return self._date(F.trunc(_as(d, "date"), "MONTH"))

    def fn_eom(self, d: Value) -> Value:
        return self._date(F.last_day(_as(d, "date")))

    def fn_soy(self, d: Value) -> Value:
        return self._date(F.trunc(_as(d, "date"), "YEAR"))

    def fn_eoy(self, d: Value) -> Value:
        return self._date(F.make_date(F.year(_as(d, "date")), F.lit(12), F.lit(31)))

    def fn_soq(self, d: Value) -> Value:
        return self._date(F.trunc(_as(d, "date"), "QUARTER"))

    def fn_eoq(self, d: Value) -> Value:
        return self._date(F.last_day(F.add_months(F.trunc(_as(d, "date"), "QUARTER"), 2)))

    def fn_sofy(self, d: Value) -> Value:
        x, m = _as(d, "date"), self.scope.fiscal_month
        return self._date(F.make_date(F.year(x) - F.when(F.month(x) < m, 1).otherwise(0), F.lit(m), F.lit(1)))

    def fn_eofy(self, d: Value) -> Value:
        return self._date(F.date_sub(F.add_months(self.fn_sofy(d).column, 12), 1))

    def fn_datepart(self, d: Value, part: Value) -> Value:
        return Value(F.date_part(F.lit(str(part.literal)), d.column if d.type == "time" else _as(d, "date")).cast("int"), "number")

    def fn_datediff(self, a: Value, b: Value, unit: Value | None = None) -> Value:
        name = UNITS.get(str(unit.literal).upper() if unit else "D")
        if not name:
            raise FormulaError(f"unknown unit {unit.literal}", 0)
        if name == "DAY":
            return Value(F.datediff(_as(a, "date"), _as(b, "date")), "number")
        cast = lambda v: _as(v, "date") if v.type != "time" else v.column
        return Value(F.timestamp_diff(name, cast(b), cast(a)), "number")

    def fn_todate(self, x: Value, form: Value | None = None) -> Value:
        if form is None:
            return self._date(_as(x, "date"))
        name = str(form.literal).upper()
        if name not in DATE_FORMATS:
            raise FormulaError(f"unknown date format {form.literal}", 0)
        return self._date(F.try_to_date(_as(x, "text"), DATE_FORMATS[name]))

    fn_date = fn_todate

    def fn_addday(self, d: Value, n: Value) -> Value:
        return self._date(F.date_add(_as(d, "date"), _as(n, "number").cast("int")))

    def fn_period(self, basis: Value, offset: Value, d: Value) -> Value:
        """A date moved by an offset of whole units."""
        name, n = UNITS.get(str(basis.literal).upper()), _as(offset, "number").cast("int")
        months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}.get(name)
        if not name or not months and name not in ("DAY", "WEEK"):
            raise FormulaError(f"unknown time basis {basis.literal}", 0)
        return self._date(F.add_months(_as(d, "date"), n * months) if months else F.date_add(_as(d, "date"), n * (7 if name == "WEEK" else 1)))

    def fn_round(self, x: Value, digits: Value | None = None) -> Value:
        return Value(F.round(_as(x, "number").cast("decimal(38,10)"), int(digits.literal) if digits else 0), "number")

    def fn_abs(self, x: Value) -> Value:
        return Value(F.abs(_as(x, "number")), "number")

    def _step(self, f, x: Value, m: Value | None) -> Value:
        by = _as(m, "number") if m else F.lit(1)
        return Value(f(F.try_divide(_as(x, "number"), by)) * by if m else f(_as(x, "number")), "number")

    def fn_floor(self, x: Value, m: Value | None = None) -> Value:
        return self._step(F.floor, x, m)

    def fn_ceil(self, x: Value, m: Value | None = None) -> Value:
        return self._step(F.ceil, x, m)


def formula(df: DataFrame, text: str, parameters: Mapping[str, object] | None = None, business_date: dt.date | None = None, **scope) -> Column:
    """The column of a formula over df."""
    return Compiler(Scope(df.schema, parameters or {}, business_date, frame=df, **scope)).value(parse(text)).column
