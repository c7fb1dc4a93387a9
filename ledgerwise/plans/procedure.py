"""Procedures run over DataFrames: each statement is a transformation of the tables it writes.

A procedure's text becomes blocks, branches and loops; IF, WHILE and EXIT are decided on the driver
from bound variables. Expressions are given to Spark SQL after variables are replaced by their
values and the dialect's own forms by Spark's; SYSDATE is the business date. UPDATE reads the
values before it. Functions of assignments, IF and RETURN are put into the expressions that call
them, as CASE. What isn't understood raises ``ProcedureError``; nothing is skipped in silence.

A block with an EXCEPTION part is evaluated at its end, and if that fails, once more statement by
statement, so that the writes before the failing one stay and the handler that names the error
runs. Tables written in a loop are written out after each turn, which bounds their plans.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lint import without_comments
from ..operators.steps import _unique, merge as merge_rows, small
from ..sources.store import stash
from .spoken import closing, conjuncts, each_call, outside_quotes, to_spark
from .statements import _OBJECT, _PATH, _masked, _peeled, classify, plain_name, split_statements, top_find, top_split

TURNS = 10_000


class ProcedureError(ValueError):
    """What a procedure raises, or what can't be run; `name` is what a handler may name."""

    def __init__(self, name: str, message: str = ""):
        super().__init__(f"{name}: {message}" if message else name)
        self.name = name


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool | int | float):
        return str(v).upper() if isinstance(v, bool) else repr(v)
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP_NTZ'{v.isoformat(' ')}'"
    if isinstance(v, dt.date):
        return f"DATE'{v.isoformat()}'"
    return str(v) if type(v).__name__ == "Decimal" else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _assignments(text: str) -> list[tuple[str, str]]:
    """(column, right-hand side) of a SET list."""
    pairs = [p.partition("=")[::2] for p in top_split(text)]
    return [(plain_name(a), b.strip()) for a, b in pairs]


# --- text to blocks -------------------------------------------------------------------------


@dataclass
class Step:
    """A statement; or, by kind: if, loop, block, exit, continue, return, raise."""

    kind: str
    text: str = ""
    branches: list[tuple[str, list[Step]]] = field(default_factory=list)  # conditions, "" for ELSE; of a block, names of its handlers
    body: list[Step] = field(default_factory=list)


@dataclass
class Routine:
    name: str
    kind: str
    parameters: list[str]
    body: list[Step]


_LOOP = re.compile(r"(?is)\s*((?:WHILE\b.+?|FOR\s+\w+\s+IN\b.+?)?\bLOOP)\b")
_IDLE = re.compile(r"(?i)\s*(?:NULL|COMMIT(?:\s+(?:WORK|TRAN(?:SACTION)?))?|SET\s+(?:NOCOUNT|ANSI_NULLS|QUOTED_IDENTIFIER|XACT_ABORT)\s+(?:ON|OFF)|PRINT\b.*|DBMS_OUTPUT\s*\.\s*PUT_LINE\b.*|DELIMITER\b.*|/+|GO)\s*", re.S)


class _Reader:
    """The statements of a text as nested steps."""

    def __init__(self, sql: str, dialect: str):
        self.todo, self.at, self.dialect = [], 0, dialect
        for s in split_statements(without_comments(sql), dialect):
            self._put(re.sub(r"(?m)^\s*/\s*$", "", s).strip())

    def _put(self, s: str) -> None:
        while s:
            if (m := _LOOP.match(_masked(s))) and m.end() < len(s) or m and m.end() == len(s):
                self.todo.append(s[: m.end()].strip())
                s = s[m.end() :].strip()
                continue
            if m := re.match(r"(?is)END\s+(?=ELSE\b)", s):
                self.todo.append("END")
                s = s[m.end() :]
                continue
            parts = _peeled(s)
            if len(parts) > 1:
                self.todo.append(parts[0])
                s = s[s.index(parts[0]) + len(parts[0]) :].strip()
                continue
            self.todo.append(s)
            return

    @property
    def word(self) -> str:
        if self.at >= len(self.todo):
            return ""
        m = re.match(r"\s*([\w@#]+)(?:\s+(\w+))?", self.todo[self.at])
        first, second = (m[1].upper(), (m[2] or "").upper()) if m else ("", "")
        return f"END {second}" if first == "END" and second in ("IF", "LOOP", "CASE", "WHILE") else first

    def take(self) -> str:
        self.at += 1
        return self.todo[self.at - 1]

    def steps(self, *stop: str) -> list[Step]:
        out = []
        while self.at < len(self.todo) and self.word not in stop:
            if self.word in ("CREATE",) and re.match(rf"(?is)\s*{_OBJECT}", self.todo[self.at]):
                break
            out += self.step()
        return out

    def step(self) -> list[Step]:
        word, text = self.word, self.take()
        if word in ("BEGIN", "DECLARE") and not re.match(r"(?i)\s*BEGIN\s+TRAN", text):
            return [self.block(text if word == "DECLARE" else "")] if word == "BEGIN" or self.dialect != "sqlserver" else [Step("declare", text)]
        if word == "IF" and re.search(r"(?i)\bTHEN\s*$", text):
            branches, condition = [], _condition(text)
            while True:
                branches.append((condition, self.steps("ELSIF", "ELSEIF", "ELSE", "END IF")))
                word, text = self.word, self.take() if self.at < len(self.todo) else ""
                if word in ("ELSIF", "ELSEIF"):
                    condition = _condition(text)
                elif word == "ELSE":
                    condition = ""
                elif word == "END IF":
                    return [Step("if", branches=branches)]
                else:
                    raise ProcedureError("SYNTAX", "an IF isn't closed")
        if word == "IF" and self.dialect == "sqlserver":
            branches = [(re.sub(r"(?is)^\s*IF\b", "", text), self.one())]
            if self.word == "ELSE":
                self.take()
                branches.append(("", self.one()))
            return [Step("if", branches=branches)]
        if word == "WHILE" and self.dialect == "sqlserver" and not _LOOP.match(_masked(text)):
            return [Step("loop", "WHILE " + re.sub(r"(?is)^\s*WHILE\b", "", text), body=self.one())]
        if m := _LOOP.fullmatch(_masked(text)):
            body = self.steps("END LOOP")
            self.end("END LOOP")
            return [Step("loop", text[: m.end()].strip()[:-4].strip(), body=body)]
        if word in ("EXIT", "CONTINUE", "BREAK"):
            m = re.match(r"(?is)\s*\w+(?:\s+WHEN\b(.+))?$", text)
            return [Step("continue" if word == "CONTINUE" else "exit", (m[1] or "true").strip())]
        if word == "RETURN":
            return [Step("return", re.sub(r"(?is)^\s*RETURN\b", "", text).strip())]
        if word in ("RAISE", "THROW"):
            return [Step("raise", re.sub(r"(?is)^\s*\w+", "", text).strip())]
        return [] if _IDLE.fullmatch(text) else [Step("sql", text)]

    def one(self) -> list[Step]:
        return self.step() if self.at < len(self.todo) else []

    def block(self, declared: str = "") -> Step:
        """A block after its BEGIN, or after a DECLARE."""
        out = Step("block")
        if declared:
            out.branches, first = [], re.sub(r"(?is)^\s*DECLARE\b", "", declared).strip()
            out.body += [Step("declare", first)] if first else []
            out.body += self.declarations()
            if self.word == "BEGIN":
                self.take()
        out.body += self.steps("END", "EXCEPTION")
        if self.word == "EXCEPTION":
            self.take()
            while self.word == "WHEN":
                names = re.sub(r"(?is)^\s*WHEN\b(.*)\bTHEN\s*$", r"\1", self.take())
                out.branches.append((names.strip().upper(), self.steps("WHEN", "END")))
        self.end("END")
        return out

    def declarations(self) -> list[Step]:
        out = []
        while self.at < len(self.todo) and self.word not in ("BEGIN", "CREATE"):
            out.append(Step("declare", self.take()))
        return out

    def end(self, word: str) -> None:
        if self.word != word:
            raise ProcedureError("SYNTAX", f"{word} is missing")
        self.take()

    def routine(self) -> Routine:
        head = self.take()
        m = re.match(rf"(?is)\s*{_OBJECT}\s*", head)
        rest = head[m.end() :]
        inside = rest[1 : closing(_masked(rest), 0)] if rest.startswith("(") else rest[: re.search(r"(?i)\b(?:AS|IS|RETURNS?)\b|$", rest).start()]
        parameters = [re.match(r"\s*([\w@]+)", p)[1].lower() for p in top_split(inside) if p.strip()]
        body = self.declarations() if self.dialect != "sqlserver" else []
        if self.word == "BEGIN":
            self.take()
            block = self.block()
            body = [Step("block", branches=block.branches, body=body + block.body)]
        else:
            body = body + self.steps()
        return Routine(plain_name(m[2]).lower(), m[1].upper(), parameters, body)

    def script(self) -> tuple[dict[str, Routine], list[Step]]:
        """The routines by name, and the statements outside them."""
        routines, loose = {}, []
        while self.at < len(self.todo):
            if self.word == "CREATE" and re.match(rf"(?is)\s*{_OBJECT}", self.todo[self.at]):
                r = self.routine()
                routines[r.name] = r
            elif self.word == "END":
                raise ProcedureError("SYNTAX", "an END has no beginning")
            else:
                loose += self.step()
        return routines, loose


def _condition(header: str) -> str:
    return re.sub(r"(?is)^\s*\w+\b(.*)\bTHEN\s*$", r"\1", header).strip()


def _texts(steps: list[Step]) -> Iterator[str]:
    for s in steps:
        yield s.text
        for _, b in s.branches:
            yield from _texts(b)
        yield from _texts(s.body)


_CALL = re.compile(rf"(?is)\s*(?:CALL\s+|EXEC(?:UTE)?\s+(?!IMMEDIATE\b))?({_PATH})\s*(\(.*\)|[^()=:]*)\s*$")
_SET = re.compile(r"(?is)\s*(?:SET\s+)?(@?\w+)\s*:?=\s*(.+)$")


def _assignment(text: str) -> re.Match | None:
    return _SET.match(text) if classify(text) in ("OTHER", "CONTROL_FLOW") else None


# --- running --------------------------------------------------------------------------------


class _Leave(Exception):
    """EXIT, CONTINUE or RETURN on its way to what it leaves."""

    def __init__(self, kind: str):
        self.kind = kind


@dataclass
class Procedure:
    spark: SparkSession
    tables: dict[str, DataFrame]
    variables: dict[str, object] = field(default_factory=dict)
    business_date: dt.date | None = None
    dialect: str = "oracle"

    def __post_init__(self):
        self.tables = {plain_name(k).lower(): v for k, v in self.tables.items()}
        self.variables = {k.lower(): v for k, v in self.variables.items()}
        self.routines: dict[str, Routine] = {}
        self.careful = False

    # expressions

    def bound(self, sql: str) -> str:
        """sql with variables and SYSDATE replaced, outside quotes and dotted names."""
        names = dict(self.variables) | ({"sysdate": self.business_date} if self.business_date else {})
        if not names:
            return sql
        pattern = re.compile(r"('(?:[^']|'')*')|(?<![\w.@#])(" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?![\w.(])", re.I)
        return pattern.sub(lambda m: m[1] or _literal(names[m[2].lower()]), sql)

    def inlined(self, sql: str) -> str:
        """sql with calls of the text's own functions replaced by their expressions."""
        for r in self.routines.values():
            if r.kind == "FUNCTION" and re.search(rf"(?i)\b{r.name}\s*\(", _masked(sql)):
                sql = each_call(sql, rf"(?:\w+\s*\.\s*)?{r.name}", lambda a, r=r: f"({_returned(r.body, dict(zip(r.parameters, (f'({x})' for x in a))))})")
        return sql

    def expression(self, sql: str) -> str:
        return to_spark(self.bound(self.inlined(sql)), self.tables, self.dialect)

    def query(self, sql: str) -> DataFrame:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name.lstrip("#"))
        return self.spark.sql(self.expression(sql))

    def test(self, condition: str) -> bool:
        return bool(self.query(f"SELECT ({condition}) AS __value").first()[0])

    # control

    def run(self, sql: str, entry: str | None = None) -> dict[str, DataFrame]:
        """The tables after the statements outside routines, or else after `entry` or the procedures that no other calls."""
        reader = _Reader(sql, self.dialect)
        self.routines, loose = reader.script()
        procedures = [r for r in self.routines.values() if r.kind == "PROCEDURE"]
        if entry:
            procedures = [self.routines[plain_name(entry).lower()]]
        elif loose:
            procedures = []
        else:
            called = {r.name for r in procedures for o in procedures if o is not r and any((m := _CALL.match(t)) and plain_name(m[1]).lower() == r.name for t in _texts(o.body))}
            procedures = [r for r in procedures if r.name not in called]
        for body in [loose, *(r.body for r in procedures)]:
            try:
                self.steps(body)
            except _Leave as leave:
                if leave.kind != "return":
                    raise ProcedureError("SYNTAX", f"{leave.kind} outside a loop") from None
        return self.tables

    def steps(self, body: list[Step]) -> None:
        for s in body:
            getattr(self, f"_{s.kind}")(s)

    def _sql(self, s: Step) -> None:
        before = dict(self.tables)
        try:
            self.statement(s.text)
            if self.careful:
                self.settle(before)
        except (ProcedureError, PySparkException):
            self.tables = before
            raise

    def settle(self, before: dict[str, DataFrame]) -> None:
        """Evaluate the tables that changed."""
        for name, df in self.tables.items():
            if before.get(name) is not df:
                self.tables[name] = stash(df, "settled")

    def _if(self, s: Step) -> None:
        for condition, body in s.branches:
            if not condition or self.test(condition):
                return self.steps(body)

    def _loop(self, s: Step) -> None:
        counter = None
        if m := re.match(r"(?is)\s*FOR\s+(\w+)\s+IN\s+(REVERSE\s+)?(.+?)\.\.(.+)$", s.text):
            a, b = (int(self.query(f"SELECT {x} AS __value").first()[0]) for x in (m[3], m[4]))
            counter = iter(range(b, a - 1, -1) if m[2] else range(a, b + 1))
        elif re.match(r"(?i)\s*FOR\b", s.text):
            raise ProcedureError("UNSUPPORTED", "a loop over a cursor works row by row; write it as one statement")
        old = self.variables.get(m[1].lower()) if m else None
        for turn in range(TURNS + 1):
            if turn == TURNS:
                raise ProcedureError("LOOP", f"no end after {TURNS} turns")
            if counter is not None:
                if (value := next(counter, None)) is None:
                    break
                self.variables[m[1].lower()] = value
            elif s.text and not self.test(re.sub(r"(?is)^\s*WHILE\b", "", s.text)):
                break
            before = dict(self.tables)
            try:
                self.steps(s.body)
            except _Leave as leave:
                if leave.kind == "return":
                    raise
                if leave.kind == "exit":
                    break
            self.settle(before)
        if m:
            self.variables.pop(m[1].lower(), None)
            if old is not None:
                self.variables[m[1].lower()] = old

    def _exit(self, s: Step) -> None:
        if self.test(s.text):
            raise _Leave(s.kind)

    _continue = _exit

    def _return(self, s: Step) -> None:
        raise _Leave("return")

    def _raise(self, s: Step) -> None:
        raise ProcedureError(plain_name(s.text.split("(")[0]).upper() or "RAISED", s.text)

    def _declare(self, s: Step) -> None:
        text = re.sub(r"(?is)^\s*DECLARE\b", "", s.text)
        for part in top_split(text) if self.dialect == "sqlserver" else [text]:
            m = re.match(r"(?is)\s*(@?\w+)\s+(?:CONSTANT\s+)?[\w%.]+(?:\s*\([^()]*\))?(?:%\w+)?(?:\s+NOT\s+NULL)?\s*(?:(?::?=|DEFAULT\b)(.+))?$", part)
            if not m or m[1].upper() in ("CURSOR", "TYPE", "PRAGMA"):
                raise ProcedureError("UNSUPPORTED", f"declaration {part.strip()[:80]}")
            if m[2]:
                self.variables[m[1].lower()] = self.query(f"SELECT {m[2]} AS __value").first()[0]
            else:
                self.variables.setdefault(m[1].lower(), None)

    def _block(self, s: Step) -> None:
        if not s.branches:
            return self.steps(s.body)
        tables, variables, careful = dict(self.tables), dict(self.variables), self.careful
        try:
            self.steps(s.body)
            self.settle(tables)
            return None
        except PySparkException as e:
            error = e
            if not careful:  # which statement failed, and what stays before it
                self.tables, self.variables, self.careful = tables, variables, True
                try:
                    self.steps(s.body)
                    return None
                except (ProcedureError, PySparkException) as again:
                    error = again
                finally:
                    self.careful = careful
        except ProcedureError as e:
            error = e
        name = error.name if isinstance(error, ProcedureError) else "ZERO_DIVIDE" if "DIVIDE_BY_ZERO" in str(error) else "OTHERS"
        if name in ("UNSUPPORTED", "SYNTAX") or not isinstance(error, ProcedureError) and re.match(r"\[(?:PARSE_SYNTAX_ERROR|UNRESOLVED_)", str(error)):
            raise error  # not an error of the data: the text can't be run
        for names, body in s.branches:
            if {name, "OTHERS"} & set(re.split(r"\s+OR\s+", names)):
                self.variables["sqlerrm"] = str(error).split("\n")[0]
                return self.steps(body)
        raise error

    # statements

    def statement(self, sql: str) -> None:
        kind = classify(sql)
        if m := _assignment(sql):
            self.variables[m[1].lower()] = self.query(f"SELECT {m[2]} AS __value").first()[0]
        elif kind in ("UPDATE", "MERGE", "INSERT", "DELETE"):
            self.numbered(sql, kind)
        elif kind == "SELECT":
            self.select_into(sql)
        elif m := re.match(rf"(?is)\s*TRUNCATE\s+TABLE\s+({_PATH})\s*$", sql):
            name = self.named(m[1])
            self.tables[name] = self.tables[name].limit(0)
        elif m := re.match(rf"(?is)\s*DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?(#?{_PATH})\s*$", sql):
            self.tables.pop(plain_name(m[1]).lower(), None)
        elif (m := _CALL.match(sql)) and (r := self.routines.get(plain_name(m[1]).lower())) and r.kind == "PROCEDURE":
            self.call(r, top_split(m[2].strip().removeprefix("(").removesuffix(")")) if m[2].strip(" ()") else [])
        else:
            raise ProcedureError("UNSUPPORTED", f"statement {' '.join(sql.split())[:100]}")

    def call(self, r: Routine, arguments: list[str]) -> None:
        values = [self.query(f"SELECT {a.rpartition('=>')[2] if '=>' in a else a} AS __value").first()[0] for a in arguments]
        names = [a.partition("=>")[0].strip().lower() if "=>" in a else p for a, p in zip(arguments, r.parameters)]
        if len(names) != len(arguments):
            raise ProcedureError("SYNTAX", f"{r.name} takes {len(r.parameters)} arguments")
        outer, self.variables = self.variables, dict(zip(names, values))
        try:
            self.steps(r.body)
        except _Leave as leave:
            if leave.kind != "return":
                raise
        finally:
            self.variables = outer

    def named(self, path: str) -> str:
        if (name := plain_name(path).lower()) not in self.tables:
            raise ProcedureError("UNSUPPORTED", f"no table {path}")
        return name

    def numbered(self, sql: str, kind: str) -> None:
        """A write whose target shows ROWID, if the statement reads it, as a number of its rows."""
        run = getattr(self, kind.lower())
        if not re.search(r"(?i)\bROWID\b", _masked(sql)):
            return run(sql)
        name = self.named(re.match(rf"(?is)\s*(?:UPDATE|MERGE\s+INTO|INSERT\s+INTO|DELETE(?:\s+FROM)?)\s+({_PATH})", sql)[1])
        self.tables[name] = stash(self.tables[name].withColumn("__rowid", F.monotonically_increasing_id()), "numbered")
        run(outside_quotes(sql, r"(?i)\bROWID\b", "__rowid"))
        self.tables[name] = self.tables[name].drop("__rowid")

    def insert(self, sql: str) -> None:
        m = re.match(rf"(?is)\s*INSERT\s+INTO\s+({_PATH})\s*(\((?!\s*SELECT\b)[^()]*\))?\s*(.+)$", sql)
        name, rows = plain_name(m[1]).lower(), self.query(m[3])
        if name not in self.tables:
            self.tables[name] = rows.toDF(*(plain_name(c) for c in top_split(m[2][1:-1]))) if m[2] else rows
            return
        target = self.tables[name]
        columns = [self._name(target, plain_name(c)) for c in top_split(m[2][1:-1])] if m[2] else target.columns
        types = dict(target.dtypes)
        if unknown := set(columns) - set(types):
            raise ProcedureError("UNSUPPORTED", f"{name} has no column {', '.join(sorted(unknown))}")
        rows = rows.toDF(*columns).select(*(F.col(f"`{c}`").cast(types[c]).alias(c) for c in columns))
        self.tables[name] = target.unionByName(rows, allowMissingColumns=True)

    def delete(self, sql: str) -> None:
        m = re.match(rf"(?is)\s*DELETE\s+(?:FROM\s+)?({_PATH})(?:\s+(?!WHERE\b|FROM\b)(\w+))?(?:\s+WHERE\b(.+))?$", sql)
        if not m:
            raise ProcedureError("UNSUPPORTED", f"statement {' '.join(sql.split())[:100]}")
        name = self.named(m[1])
        if not m[3]:
            self.tables[name] = self.tables[name].limit(0)
            return
        old, alias = self.tables[name], m[2] or name
        if not re.search(r"(?i)\bSELECT\b", m[3]):
            self.tables[name] = self.query(f"SELECT * FROM {name} {alias} WHERE NOT coalesce(({m[3]}), false)")
            return
        self.tables[name] = rows = stash(old.withColumn("__row", F.monotonically_increasing_id()), "delete")  # subqueries go to a filter, which Spark turns into joins
        gone = self.query(f"SELECT {alias}.__row AS __gone FROM {name} {alias} WHERE {m[3]}")
        self.tables[name] = rows.join(gone, F.col("__row") == F.col("__gone"), "left_anti").drop("__row")

    def select_into(self, sql: str) -> None:
        if self.dialect == "sqlserver" and (m := re.match(r"(?is)\s*SELECT\s+(@\w+\s*=.*)$", sql)):
            end = top_find(m[1], r"\bFROM\b")
            pairs = _assignments(m[1][: end.start()] if end else m[1])
            rows = self.query(f"SELECT {', '.join(v for _, v in pairs)} {m[1][end.start() :] if end else ''}").limit(1).collect()
            self.variables |= {k.lower(): v for (k, _), v in zip(pairs, rows[0] if rows else ())}
            return
        a = top_find(sql, rf"\bINTO\s+{_PATH}(?:\s*,\s*{_PATH})*")
        if not a:
            raise ProcedureError("UNSUPPORTED", "a SELECT without INTO gives its rows to nobody")
        names = [plain_name(x).lower() for x in re.sub(r"(?i)^INTO\s+", "", sql[a.start() : a.end()]).split(",")]
        rows = self.query(sql[: a.start()] + sql[a.end() :])
        if names[0].startswith("#") or names[0] not in self.variables and self.dialect == "sqlserver":
            self.tables[names[0]] = rows
            return
        found = rows.limit(2).collect()
        if len(found) != 1:
            raise ProcedureError("TOO_MANY_ROWS" if found else "NO_DATA_FOUND", " ".join(sql.split())[:80])
        self.variables |= dict(zip(names, found[0]))

    def update(self, sql: str) -> None:
        m = re.match(rf"(?is)\s*UPDATE\s+({_PATH})(?:\s+(?:AS\s+)?(?!SET\b)(\w+))?\s+SET\b", sql)
        rest = sql[m.end() :]
        source, where = top_find(rest, r"\bFROM\b"), top_find(rest, r"\bWHERE\b")
        sets = _assignments(rest[: min(x.start() for x in (source, where) if x) if source or where else len(rest)])
        guard = rest[where.end() :] if where else "true"
        if source:
            return self.update_from(plain_name(m[1]), sets, rest[source.end() : where.start() if where else len(rest)], guard)
        name = self.named(m[1])
        alias, old = m[2] or name, self.tables[name]
        new = {c.lower(): v for c, v in sets}
        if unknown := set(new) - {c.lower() for c in old.columns}:
            raise ProcedureError("UNSUPPORTED", f"{name} has no column {', '.join(sorted(unknown))}")
        types = {c.lower(): t for c, t in old.dtypes}
        flag = f"CASE WHEN {guard} THEN true ELSE false END"
        if re.search(r"(?i)\bSELECT\b", guard):  # subqueries go to a filter, which Spark turns into semi joins; the flag comes back by row number
            self.tables[name] = rows = stash(old.withColumn("__row", F.monotonically_increasing_id()), "update")
            hit = self.query(f"SELECT {alias}.__row AS __hit FROM {name} {alias} WHERE {guard}")
            self.tables[name] = rows.join(hit, F.col("__row") == F.col("__hit"), "left").drop("__row")
            flag = f"{alias}.__hit IS NOT NULL"
        columns = [f"CAST(CASE WHEN {flag} THEN {new[c.lower()]} ELSE {alias}.`{c}` END AS {types[c.lower()]}) AS `{c}`" if c.lower() in new else f"{alias}.`{c}`" for c in old.columns]
        self.tables[name] = self.query(f"SELECT {', '.join(columns)} FROM {name} {alias}")
        return None

    def update_from(self, name: str, sets: list[tuple[str, str]], joined: str, guard: str) -> None:
        alias, table = name, self.named(next((plain_name(t) for t, a in re.findall(rf"(?i)({_PATH})(?:\s+(?:AS\s+)?(\w+))?", joined) if a.lower() == name.lower()), name))
        target, key = self.tables[table], "__row"
        self.tables[table] = rows = stash(target.withColumn(key, F.monotonically_increasing_id()), "update")  # so that row numbers stay
        changed = self.query(f"SELECT {alias}.{key}, {', '.join(f'{v} AS `{c}`' for c, v in sets)} FROM {joined} WHERE {guard}")
        self.tables[table] = merge_rows(rows, _unique(changed, [key]).select(key, "_row.*"), [key], {self._name(target, c): c for c, _ in sets}).drop(key)

    @staticmethod
    def _name(df: DataFrame, column: str) -> str:
        return next((c for c in df.columns if c.lower() == column.lower()), column)

    def merge(self, sql: str) -> None:
        m = re.match(rf"(?is)\s*MERGE\s+INTO\s+({_PATH})(?:\s+(?:AS\s+)?(?!USING\b)(\w+))?\s+USING\s*", sql)
        name, rest = self.named(m[1]), sql[m.end() :]
        t = m[2] or name
        on = top_find(rest, r"\bON\b")
        head = re.match(r"(?is)\s*(\(.*\)|[\w.#\"\[\]]+)\s*(?:AS\s+)?(\w*)\s*$", rest[: on.start()])
        s = head[2] or ("__s" if head[1].startswith("(") else plain_name(head[1]))
        clauses = [x for x in re.split(r"\x00", _cut(rest[on.end() :], r"\bWHEN\s+(?=(?:NOT\s+)?MATCHED\b)"))]
        target = self.tables[name]
        source = self.query(f"SELECT * FROM {head[1]} {s}")
        Merge(self, target.alias(t), source.alias(s), t, s, target.dtypes, source.columns).apply(clauses[0], clauses[1:], name)


def _cut(text: str, pattern: str) -> str:
    """text with \\x00 in place of each match outside parentheses and CASE."""
    out, at = "", 0
    while m := top_find(text, pattern, at):
        out += text[at : m.start()] + "\x00"
        at = m.end()
    return out + text[at:]


_WHEN = re.compile(r"(?is)\s*(NOT\s+)?MATCHED(?:\s+BY\s+TARGET)?(?:\s+AND\b(.+?))?\s*\bTHEN\b\s*(UPDATE\s+SET\b|DELETE\b|INSERT\b)(.*)$")


@dataclass
class Merge:
    """One MERGE over aliased frames t (its target) and s (its source)."""

    owner: Procedure
    target: DataFrame
    source: DataFrame
    t: str
    s: str
    types: list[tuple[str, str]]
    columns: list[str]

    def expr(self, text: str) -> Column:
        return F.expr(self.owner.expression(text))

    def side(self, text: str) -> set[str]:
        """Which of t and s a condition reads."""
        out, masked = set(), re.sub(r"'[^']*'", "''", self.owner.expression(text))
        names = {self.t.lower(): "t", self.s.lower(): "s"}
        for a, b in re.findall(r"(?:([\w`]+)\s*\.\s*)?([A-Za-z_`][\w`]*)(?!\s*[.(\w])", masked):
            a, b = a.strip("`").lower(), b.strip("`").lower()
            if a:
                if a not in names:
                    raise ProcedureError("UNSUPPORTED", f"{a}.{b} in a MERGE")
                out.add(names[a])
            else:
                mine, other = b in {c.lower() for c, _ in self.types}, b in {c.lower() for c in self.columns}
                if mine and other:
                    raise ProcedureError("UNSUPPORTED", f"{b} is in both sides of a MERGE")
                out |= {"t"} if mine else {"s"} if other else set()
        return out

    def apply(self, on: str, clauses: list[str], name: str) -> None:
        pairs, mixed, mine, own = [], [], [], []
        for part in conjuncts(on):
            a, eq, b = (lambda m: (part[: m.start()], True, part[m.end() :]) if m else (part, False, ""))(top_find(part, r"(?<![<>!=:])=(?!=)"))
            if eq and {frozenset(self.side(a)), frozenset(self.side(b))} == {frozenset("t"), frozenset("s")}:
                pairs.append((a, b) if self.side(a) == {"t"} else (b, a))
            else:
                side = self.side(part)
                (mixed if side == {"t", "s"} else own if side == {"s"} else mine).append(part)
        source = self.source
        for part in own:
            source = source.where(self.expr(part))
        source = source.select(F.struct(*(F.col(f"{self.s}.`{c}`") for c in self.columns)).alias("__s")).select("__s", *self._keys(pairs))
        parsed = [self._clause(c) for c in clauses]
        matched = [c for c in parsed if not c[0]]
        columns = [c for c, _ in self.types]
        if matched:
            both = self._joined(source, pairs, mine, mixed)
            self.owner.tables[name] = self._changed(both, matched).select(*columns)
        if made := [c for c in parsed if c[0]]:
            self.owner.tables[name] = self.owner.tables[name].unionByName(self._inserted(pairs, mine, mixed, made), allowMissingColumns=True)

    def _keys(self, pairs: list[tuple[str, str]]) -> list[Column]:
        inner = self.owner.expression
        shown = lambda text: re.sub(rf"(?i)(?<![\w.`])`?{self.s}`?\s*\.\s*", "__s.", inner(text))
        bare = lambda text: re.sub(r"(?<![\w.'`])([A-Za-z_]\w*)(?![\w.(])", lambda m: f"__s.{m[1]}" if m[1].lower() in {c.lower() for c in self.columns} else m[0], text)
        return [F.expr(bare(shown(b))).alias(f"__k{i}") for i, (_, b) in enumerate(pairs)]

    def _on(self, pairs: list[tuple[str, str]], mine: list[str]) -> Column:
        out = F.lit(True)
        for i, (a, _) in enumerate(pairs):
            out = out & (self.expr(a) == F.col(f"__k{i}"))
        for part in mine:
            out = out & F.coalesce(self.expr(part), F.lit(False))
        return out

    def _joined(self, source: DataFrame, pairs: list[tuple[str, str]], mine: list[str], mixed: list[str]) -> DataFrame:
        """t's columns, those of the source row that matches as a struct __s, and how many match as __n."""
        keys = [f"__k{i}" for i in range(len(pairs))]
        if pairs and not mixed:
            one = source.groupBy(*keys).agg(F.first("__s").alias("__s"), F.count("*").alias("__n"))
            return self.target.join(one, self._on(pairs, mine), "left")
        rows = stash(self.target.withColumn("__t", F.monotonically_increasing_id()), "merge").alias(self.t)
        flat = source.select(*keys, "__s", "__s.*").alias(self.s)
        condition = self._on(pairs, mine)
        for part in mixed:
            condition = condition & self.expr(part)
        if not pairs:
            flat = small(flat)
            if not flat.isEmpty() and flat.count() > 100_000:
                raise ProcedureError("UNSUPPORTED", "a MERGE on ranges alone with a large source")
        hits = rows.join(flat, condition).groupBy(F.col(f"{self.t}.__t").alias("__h")).agg(F.first("__s").alias("__s"), F.count("*").alias("__n"))
        return rows.join(hits, F.col("__t") == F.col("__h"), "left").drop("__t", "__h").alias(self.t)

    def _clause(self, text: str) -> tuple[bool, str, str, str, str]:
        """Whether for rows without a match, AND, action, what follows, WHERE."""
        m = _WHEN.match(text)
        if not m:
            raise ProcedureError("UNSUPPORTED", f"WHEN {' '.join(text.split())[:80]}")
        action, rest, guard = m[3].split()[0].upper(), m[4].strip().rstrip(";"), ""
        if top_find(rest, r"\bDELETE\b"):
            raise ProcedureError("UNSUPPORTED", "DELETE WHERE after an update in a MERGE")
        if w := top_find(rest, r"\bWHERE\b"):
            rest, guard = rest[: w.start()], rest[w.end() :]
        return bool(m[1]), (m[2] or "").strip(), action, rest, guard

    def _changed(self, both: DataFrame, clauses: list[tuple[bool, str, str, str, str]]) -> DataFrame:
        wide = both.withColumn("__hit", F.when(F.col("__n") > 1, F.raise_error(F.lit("a merge source repeats a key"))).otherwise(F.col("__n").isNotNull()))
        wide = wide.select(F.struct(*(F.col(f"`{c}`") for c, _ in self.types)).alias(self.t), F.col("__s").alias(self.s) if self.s != "__s" else F.col("__s"), "__hit")
        show = lambda text: self._qualified(text)
        types, done, gone = dict(self.types), F.lit(False), F.lit(False)
        values = {c: F.col(f"{self.t}.`{c}`") for c in types}
        for _, extra, action, rest, guard in clauses:
            applies = F.col("__hit") & ~done & (F.coalesce(F.expr(show(extra)), F.lit(False)) if extra else F.lit(True))
            if action == "DELETE":
                gone = gone | applies
            else:
                writes = applies & F.coalesce(F.expr(show(guard)), F.lit(False)) if guard else applies
                for c, v in _assignments(rest):
                    c = next((x for x in types if x.lower() == c.lower()), None)
                    if c is None:
                        raise ProcedureError("UNSUPPORTED", f"no column for {v[:40]}")
                    values[c] = F.when(writes, F.expr(show(v)).cast(types[c])).otherwise(values[c])
            done = done | applies
        return wide.select(*(v.alias(c) for c, v in values.items()), gone.alias("__gone")).where("NOT __gone").drop("__gone")

    def _qualified(self, text: str) -> str:
        """An expression whose unqualified columns have their side's alias; t and s are structs."""
        text = self.owner.expression(text)
        mine, other = ({c.lower() for c in x} for x in ((c for c, _ in self.types), self.columns))

        def one(m: re.Match) -> str:
            c = m[1].strip("`").lower()
            return f"{self.t}.{m[1]}" if c in mine and c not in other else f"{self.s}.{m[1]}" if c in other and c not in mine else m[0]

        return outside_quotes(text, r"(?<![\w.`'])(`\w+`|[A-Za-z_]\w*)(?!\s*[.(\w`'])", one)

    def _inserted(self, pairs: list[tuple[str, str]], mine: list[str], mixed: list[str], clauses: list[tuple[bool, str, str, str, str]]) -> DataFrame:
        """New rows of the source rows that match nothing in the table before the MERGE."""
        source = self.source.select(F.struct(*(F.col(f"{self.s}.`{c}`") for c in self.columns)).alias("__s")).select("__s", *self._keys(pairs)).select("*", "__s.*").alias(self.s)
        condition = self._on(pairs, mine)
        for part in mixed:
            condition = condition & self.expr(part)
        new = source.join(self.target, condition, "left_anti") if pairs else source.join(small(self.target), condition, "left_anti")
        out, done, types = None, F.lit(False), dict(self.types)
        for _, extra, action, rest, guard in clauses:
            if action != "INSERT":
                raise ProcedureError("UNSUPPORTED", f"{action} of rows without a match")
            parts = re.match(r"(?is)\s*(?:\((.*?)\))?\s*VALUES\s*\((.*)\)\s*$", rest)
            names = [plain_name(c) for c in top_split(parts[1])] if parts[1] else [c for c, _ in self.types]
            names = [next(x for x in types if x.lower() == c.lower()) for c in names]
            test = ~done
            for g in (extra, guard):
                test = test & F.coalesce(self.expr(g), F.lit(False)) if g else test
            rows = new.where(test).select(*(self.expr(v).cast(types[c]).alias(c) for c, v in zip(names, top_split(parts[2]))))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
            done = done | (F.coalesce(self.expr(extra), F.lit(False)) if extra else F.lit(True))
        return out


def _returned(body: list[Step], known: dict[str, str]) -> str:
    """What a function of assignments, IF and RETURN gives, as one expression of its arguments."""
    if not body:
        return "NULL"
    s, rest = body[0], body[1:]
    put = lambda text: re.compile(r"('(?:[^']|'')*')|(?<![\w.@])(@?[A-Za-z_]\w*)(?![\w.(])").sub(lambda m: m[1] or known.get(m[2].lower(), m[2]), text)
    if s.kind == "return":
        return f"({put(s.text)})"
    if s.kind == "block" and not s.branches:
        return _returned(s.body + rest, known)
    if s.kind == "declare":
        m = re.match(r"(?is)\s*(@?\w+)\s+[\w%.]+(?:\s*\([^()]*\))?\s*(?:(?::?=|DEFAULT\b)(.+))?$", s.text)
        return _returned(rest, known | {m[1].lower(): f"({put(m[2])})" if m[2] else "NULL"})
    if s.kind == "if":
        branches = [(c, _returned(b + rest, known)) for c, b in s.branches]
        if branches[-1][0]:
            branches.append(("", _returned(rest, known)))
        return f"(CASE {' '.join(f'WHEN {put(c)} THEN {v}' if c else f'ELSE {v}' for c, v in branches)} END)"
    if s.kind == "sql" and (m := _assignment(s.text)):
        return _returned(rest, known | {m[1].lower(): f"({put(m[2])})"})
    raise ProcedureError("UNSUPPORTED", f"a function with {s.kind} {s.text[:60]}")


def run(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], variables: Mapping[str, object] | None = None, business_date: dt.date | None = None, dialect: str = "oracle", entry: str | None = None) -> dict[str, DataFrame]:
    """The tables (by lower-case plain name) after a text's statements or procedures."""
    return Procedure(spark, dict(tables), dict(variables or {}), business_date, dialect).run(sql, entry)
