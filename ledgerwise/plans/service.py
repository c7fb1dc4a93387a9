"""From procedure files to dictionary rows, chains and a report: what a job does.

Text and metadata are DataFrames throughout. Each chain's columns are derived in one task, chains
apart; what stands for a language model is a plain function on the driver that is asked only where
a formula can't be composed, or is found wanting against its source.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lint import check
from ..functions.prune import prune
from ..operators import dictionary, guards, lineage, periods
from ..operators.steps import numbered
from ..sources.store import stash
from . import compose, sites, statements

ROW = "entity_name string, column_name string, column_type string, derivation_option string, display_derivation_expression string, effective_start_date date, status string, data_type string, decision_table_json string, conditional_json string, business_meaning string, source_chain_id string, source_object_id string, source_statements array<int>, source_refs array<string>, source_tables array<string>, confidence double, validation_errors array<string>, pos bigint"
#: Parameters that stand for a version.
KEYS = frozenset({"P_TIMEKEY", "TIMEKEY"})


@dataclass
class Result:
    errors: DataFrame  # file, errors
    objects: DataFrame
    statements: DataFrame
    chunks: DataFrame
    edges: DataFrame
    chains: DataFrame
    rows: DataFrame
    report: str


def meaning(column: str, formula: str | None) -> str:
    """A sentence on what a column says, from its name and formula."""
    for mark, text in (("dpd", "Days past due"), ("date", "A date"), ("dt", "A date"), ("flag", "A flag"), ("flg", "A flag"), ("reason", "A reason"), ("amt", "An amount"), ("bal", "An amount")):
        if mark in column.lower():
            return f"{text} derived {'by conditions' if formula and formula.startswith('IF(') else 'directly'} from its source."
    return f"{column}, derived {'by conditions' if formula and formula.startswith('IF(') else 'directly'} from its source."


DERIVED = "chain string, table string, entity string, column string, formula string, used array<int>, objects array<string>, refs array<string>, tables array<string>, problems array<string>, preserved boolean, source string, context string, pos bigint"


def derive_chain(rows: pd.DataFrame, names: Mapping[str, str]) -> list[dict]:
    """A formula for each column that a chain writes, folded over its objects in order, with what was found wrong with it."""
    found, owner = [], []
    for r in rows.sort_values(["at", "statement_index"]).itertuples():
        s = statements.Statement(len(found), r.statement_type, r.raw_text, list(r.tables_read), list(r.tables_written), list(r.columns), dict(r.set_columns_by_table or {}), list(r.join_tables), list(r.join_conditions), list(r.conditions), r.parsed_ok, r.parse_error)
        found.append(s)
        owner.append((r.object_id, r.name))
    known, written = sites.inventory(found), {}
    for s in found:
        for t, cs in s.set_columns_by_table.items():
            for c in cs:
                written.setdefault((t.upper(), c.upper()), (t, c))
    out = []
    for t, c in written.values():
        own = [s for s in found if t.upper() in {x.upper() for x in s.tables_written} or not s.tables_written]
        formula, used, problems = compose.compose(found, t, c, KEYS)
        places = sites.sites(own, c)
        preserved = any(sites.guarded_update(s, c) for s in own)
        named = {k: v for s in own if s.statement_type in statements.DML for k, v in statements.aliases(s.raw_text).items()}
        indices = sorted({i for p in places for i in p.statement_indices})
        source = "\n".join(found[i].raw_text for i in indices)
        if formula:
            formula = sites.grounded(sites.with_tables(formula, named), known, frozenset({t}))
            formula = formula if preserved else sites.without_trailing_self(formula, t, c)
        if sites.reads_itself_later(own, c):
            problems = [*problems, "a later write reads the column that earlier ones set"]
        if bad := sites.undeterminable(own, c):
            problems = [*problems, f"a handler writes under the same guard as statement {', '.join(map(str, bad))}"]
        objects = list(dict.fromkeys(owner[i] for i in (used or indices)))
        out.append({
            "table": t, "entity": names.get(t.upper(), t), "column": c, "formula": formula, "used": used, "objects": [o for o, _ in objects], "refs": [b for o, n in objects for b in sites.breadcrumbs(n, [p for p in places if owner[p.statement_indices[-1]][0] == o])],
            "tables": sorted({x for i in indices for x in found[i].tables_read}), "problems": problems, "preserved": preserved, "source": source, "context": sites.context(c, places, source),
        })
    return out


def derivations(found: DataFrame, ordered: DataFrame, objects: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """DERIVED rows of all chains: one task a chain."""
    place = ordered.select("object_id", "chain", F.struct(F.coalesce("level", F.lit(0)), "pos", "object_id").alias("at"))
    rows = found.join(place, "object_id").join(objects.select("object_id", "name"), "object_id")
    rows = rows.withColumn("at", F.concat_ws("/", F.lpad(F.col("at.col1").cast("string"), 9, "0"), F.lpad(F.col("at.pos").cast("string"), 12, "0"), "at.object_id"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = derive_chain(pdf, names)
        return pd.DataFrame([{"chain": key[0], **r, "pos": i} for i, r in enumerate(out)], columns=[x.split()[0] for x in DERIVED.split(", ")])

    return rows.groupBy("chain").applyInPandas(run, DERIVED)


def answered(r, model: Callable[[str], str] | None, attempts: int) -> tuple[str, str | None, str, list[str]]:
    """(option, formula, decision table, findings) of a derived row; a model is asked up to `attempts` times where there are findings."""
    test = lambda text: check(text, r.table, r.column, r.source or None, r.preserved)
    bad = list(r.problems) or test(r.formula or "")
    for _ in range(max(1, attempts) if bad and model else 0):
        kind, body = sites.answer_kind(model(f"Derive {r.entity}.{r.column}.\n{r.context}\nFindings: {'; '.join(bad)}"))
        if kind == "Decision Table":
            return kind, "", body, []
        if not (bad := check(body, r.table, r.column, None, r.preserved)):
            return kind, body, "", []
    return "Formula Expression", r.formula, "", bad


def cuts(formula: str | None, days: Mapping[int, dt.date], today: dt.date) -> list[tuple[str, dt.date]]:
    """(formula at the version, date) for each threshold that a formula tests; without one, the formula from today."""
    found: dict[int, str] = {}
    for name, _, value in re.findall(periods.THRESHOLD, formula or ""):
        found.setdefault(int(value), name)
    at = lambda v: days.get(v) or periods.DAY_ZERO + dt.timedelta(v)
    return [(prune(formula, name.lstrip("@"), value + 1), at(value)) for value, name in sorted(found.items())] or [(formula, today)]


def generate(spark: SparkSession, files: Mapping[str, str], company: str = "", platform: str = "", entities: Mapping[str, str] | None = None, time_keys: Mapping[int, dt.date] | None = None, today: dt.date | None = None, model: Callable[[str], str] | None = None, attempts: int = 2) -> Result:
    """All that a job yields for files (name to text). `today` dates rules without a version; `model` answers a prompt with a formula."""
    today = today or dt.date.today()
    source = spark.createDataFrame(sorted(files.items()), "file string, text string")
    errors = source.select("file", guards.input_errors("file", "text").alias("errors"))
    good = source.join(errors.where(F.size("errors") == 0).select("file"), "file", "left_semi")
    objects = stash(statements.split_objects(good), "objects")
    found = stash(statements.statements(objects), "statements")
    order = numbered(objects.select("object_id", "source_file", F.col("pos").alias("place")), ["source_file", "place"], "pos").select("object_id", F.col("pos").cast("int").alias("pos"))
    rolled = stash(statements.object_rollup(objects.drop("pos"), found).join(order, "object_id").withColumn("structure_errors", guards.structure_errors()), "rollup")
    links = lineage.edges(rolled)
    ordered = stash(lineage.orders(rolled, links), "orders")
    chains = lineage.chain_models(ordered, rolled)
    derived = stash(derivations(found, ordered, rolled, {k.upper(): v for k, v in (entities or {}).items()}), "derived")

    out, seen = [], set()
    for r in derived.orderBy("chain", "pos").collect():  # metadata: a row a column
        if (key := (r.entity.upper(), r.column.upper())) in seen:
            continue
        seen.add(key)
        option, formula, table, bad = answered(r, model, attempts)
        for text, day in cuts(formula, time_keys or {}, today):
            shown = text if not bad else ""  # what fails a check isn't shown as a rule
            ok = not bad and bool(text or table)
            out.append((r.entity, r.column, "Physical", option, shown, day, "ACTIVE" if ok else "PENDING_REVIEW", None, table, "", meaning(r.column, text), r.chain, (r.objects or [""])[0], r.used, r.refs, r.tables, 0.9 if ok else 0.4, bad, len(out)))
    rows = spark.createDataFrame(out, ROW).withColumns({"data_type": dictionary.inferred_type("column_name"), "grammar_errors": F.array().cast("array<string>")})
    wrong = guards.output_errors()
    rows = rows.withColumns({"validation_errors": F.concat("validation_errors", wrong), "status": F.when(F.size(wrong) > 0, "PENDING_REVIEW").otherwise(F.col("status"))}).drop("grammar_errors")
    rows = stash(dictionary.duplicates(rows), "dictionary")
    report = dictionary.report(dictionary.rules(rows), dictionary.table_use(found.join(objects.select("object_id", "name"), "object_id")), " ".join(x for x in (company, platform, "derivations") if x))
    return Result(errors, rolled, found, statements.chunk_rollup(found), links, chains, rows, report)
