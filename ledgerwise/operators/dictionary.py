"""Dictionary rows: keys, merging, deduplication, rules, reports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrow import each
from .steps import numbered

KEY = ("entity_name", "column_name", "effective_start_date")
SIGNATURE = ("entity_name", "column_name", "expression", "column_type", "derivation_option", "status", "data_type", "decision_table_json", "conditional_json")
RULE = ("entity_name", "column_name", "derivation_option", "expression", "decision_table_json", "conditional_json")


def logical_name(c: str | Column) -> Column:
    """A name without quotes and outer blanks, in upper case."""
    return F.upper(F.trim(F.regexp_replace(c, r'["\[\]`]', "")))


def expression_key(c: str | Column) -> Column:
    """An expression without white space and in lower case outside quotes; quoted parts keep both, but for the case of dotted names."""
    parts = F.split(c, '"')
    near = lambda i: F.concat(F.coalesce(F.get(parts, i - 1), F.lit("")), F.lit("\x01"), F.coalesce(F.get(parts, i + 1), F.lit("")))
    dotted = lambda i: near(i).rlike(r"\.\s*\x01|\x01\s*\.")
    one = lambda x, i: F.when(i % 2 == 0, F.lower(F.regexp_replace(x, r"\s+", ""))).when(dotted(i), F.lower(x)).otherwise(x)
    return F.array_join(F.transform(parts, one), '"')


def _part(name: str) -> Column:
    if name == "expression":
        return expression_key(F.coalesce("display_derivation_expression", F.lit("")))
    return logical_name(name) if name in ("entity_name", "column_name") else F.coalesce(F.col(name).cast("string"), F.lit(""))


def _keyed(rows: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    keys = [f"_key_{n}" for n in names]
    return rows.withColumns({k: F.col(n) if n == KEY[2] else _part(n) for k, n in zip(keys, names)}), keys


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows whose key isn't in new, and all of new."""
    old, keys = _keyed(existing, KEY)
    fresh, _ = _keyed(new, KEY)
    kept = old.join(fresh.select(*(F.col(k).alias(f"{k}_n") for k in keys)).distinct(), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_n")) for k in keys)), "left_anti")
    return kept.drop(*keys).unionByName(new, allowMissingColumns=True)


def dedupe(rows: DataFrame, order: str = "pos") -> DataFrame:
    """One row for each signature: the first, with the earliest effective date."""
    keyed, keys = _keyed(rows, SIGNATURE)
    one = keyed.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r"), F.min(KEY[2]).alias("d"))
    return one.select("r.*", "d").withColumn(KEY[2], F.col("d")).drop("d")


def rules(rows: DataFrame, order: str = "pos") -> DataFrame:
    """One row for each rule: rule_id by first occurrence, and its sorted effective dates."""
    keyed, keys = _keyed(rows, RULE)
    each = keyed.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r"), F.min(order).alias("first"), F.array_join(F.array_sort(F.collect_set(F.date_format(KEY[2], "yyyy-MM-dd"))), ", ").alias("effective_dates"))
    each = numbered(each, ["first", *keys], "_number")
    return each.select(F.format_string("BR-%03d", "_number").alias("rule_id"), "first", "effective_dates", "r.*")


def duplicates(rows: DataFrame) -> DataFrame:
    """Rows that derive a column twice from one date go to review, with confidence of at most 0.3 and the other chains named."""
    keyed, keys = _keyed(rows, KEY)
    w = Window.partitionBy(*keys)
    out = keyed.withColumns({"_n": F.count("*").over(w), "_chains": F.array_sort(F.collect_set("source_chain_id").over(w))})
    many = F.col("_n") > 1
    note = F.concat(F.lit("also derived by "), F.array_join(F.array_except("_chains", F.array("source_chain_id")), ", "))
    return out.withColumns({"status": F.when(many, "PENDING_REVIEW").otherwise(F.col("status")), "confidence": F.when(many, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")), "advisory": F.when(many, note)}).drop("_n", "_chains", *keys)


def expand_jobs(chains: DataFrame, writes: DataFrame, names: DataFrame) -> DataFrame:
    """(chain, order array), (object_id, table, columns array), (table, entity) to one job for each logical column, the first write winning."""
    place = chains.select("chain", F.posexplode("order").alias("at", "object_id")).join(writes, "object_id")
    each = place.select("chain", "at", "object_id", "table", F.posexplode("columns").alias("i", "column"))
    each = each.join(names.withColumnRenamed("table", "_t"), F.lower("table") == F.lower("_t"), "left").drop("_t").withColumn("entity", F.coalesce("entity", "table"))
    first = Window.partitionBy(logical_name("entity"), logical_name("column")).orderBy("chain", "at", "table", "i")
    return each.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "i")


def inferred_type(name: str | Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike("date|dt|_at"), "datetime").when(n.rlike("flag|flg|ind|check|reason"), "string").otherwise("number")


def role(sql: str | Column) -> Column:
    """The role of an assignment in its procedure; statements are metadata, so they are read one by one."""
    from ..plans import sites

    return each(lambda x: sites.role(x or ""))(sql)


def aggregates(sql: str | Column) -> Column:
    """The aggregate functions of a grouped statement, else none."""
    c = F.col(sql) if isinstance(sql, str) else sql
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(MIN|MAX|SUM|COUNT|AVG|LISTAGG)\s*\("), 1), F.upper)))
    return F.when(c.rlike(r"(?i)\bGROUP\s+BY\b"), found).otherwise(F.array().cast("array<string>"))


def table_use(statements: DataFrame) -> DataFrame:
    """table, the sorted objects that read it, and the sorted columns written in it."""
    read = statements.select(F.explode("tables_read").alias("table"), F.col("name").alias("reader"), F.lit(None).cast("string").alias("column"))
    wrote = statements.select(F.explode("set_columns_by_table").alias("table", "cs")).select("table", F.lit(None).cast("string").alias("reader"), F.explode("cs").alias("column"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return read.unionByName(wrote).groupBy("table").agg(joined("reader").alias("readers"), joined("column").alias("columns"))


def glossary(terms: DataFrame) -> DataFrame:
    """term, definition (the last one), first position."""
    return terms.groupBy(logical_name("term").alias("_t")).agg(F.min_by("term", "pos").alias("term"), F.max_by("definition", "pos").alias("definition"), F.min("pos").alias("first")).drop("_t")


def reference_inventory(uses: DataFrame) -> DataFrame:
    """(qualifier, column) to the sorted qualifiers of each column."""
    return uses.groupBy(F.upper("column").alias("column")).agg(F.array_sort(F.collect_set(F.upper("qualifier"))).alias("qualifiers"))


def grounded(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """refs (qualifier, column) with the qualifier replaced where it isn't known and the column has exactly one."""
    inv = inventory.withColumnRenamed("column", "_c")
    both = refs.join(inv, F.upper("column") == F.col("_c"), "left")
    wrong = (F.size("qualifiers") == 1) & ~F.array_contains("qualifiers", F.upper("qualifier"))
    return both.withColumn("qualifier", F.when(wrong, F.element_at("qualifiers", 1)).otherwise(F.col("qualifier"))).drop("_c", "qualifiers")


def alias_map(uses: DataFrame) -> DataFrame:
    """(alias, table) to the aliases that name one table only."""
    return uses.groupBy(F.upper("alias").alias("alias")).agg(F.collect_set("table").alias("t")).where(F.size("t") == 1).select("alias", F.element_at("t", 1).alias("table"))


def pending_exceptions(sites: DataFrame) -> DataFrame:
    """Sites whose guard text equals that of an exception handler, and aren't one."""
    guard = F.lower(F.regexp_replace(F.regexp_extract("raw_sql", r"(?is)\bWHERE\b(.*)$", 1), r"[\s;]+", ""))
    sites = sites.withColumns({"_g": guard, "_r": role("raw_sql")})
    handlers = sites.where("_r = 'EXCEPTION_HANDLER' AND _g <> ''").select("_g").distinct()
    return sites.where("_r <> 'EXCEPTION_HANDLER'").join(handlers, "_g", "left_semi").drop("_g", "_r")


#: What marks a technical entity, as against a business one.
TECHNICAL = r"(?i)status|log|audit|error|process|temp|tmp|stg|#"


def by_entity(numbered: DataFrame) -> DataFrame:
    """Rules in order of their entity's first rule, entities told apart as technical or business."""
    first = F.min("first").over(Window.partitionBy(logical_name("entity_name")))
    return numbered.withColumns({"entity_first": first, "is_technical": F.col("entity_name").rlike(TECHNICAL)}).orderBy("is_technical", "entity_first", "first")


def summary(rules_: int, entities: int, technical: int) -> str:
    """A line on how many rules there are."""
    return f"{rules_} rule{'s' * (rules_ != 1)} of {entities} entit{'y' if entities == 1 else 'ies'}, {technical} of them technical."


def first_sentence(text: str) -> str:
    """A text up to its first full stop."""
    return re.split(r"(?<=[.!?])\s", text.strip(), maxsplit=1)[0]


def process_name(file: str) -> str:
    """A file's name as the name of a process: without its folder, ending and underscores."""
    return re.sub(r"[_\W]+", " ", re.sub(r"\.\w+$", "", file.rpartition("/")[2])).strip()


def slug(text: str) -> str:
    """A text as a part of a file name."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def report(rules_: DataFrame, uses: DataFrame, title: str) -> str:
    """A Markdown report of numbered rules and tables; metadata, so laid out on the driver."""
    from ..functions.explain import explain, laid_out

    cell = lambda x: str(x or "").replace("|", "\\|").replace("\n", "<br>")
    found = by_entity(rules_).collect()
    technical = sum(r.is_technical for r in found)
    out = [f"# {title}", "", summary(len(found), len({r.entity_name.upper() for r in found}), technical), "", "## Rules", ""]
    for r in found:
        text, own = r.display_derivation_expression or "", r.asDict()
        scope = [f"Written by: {cell(', '.join(own['source_refs']))}"] if own.get("source_refs") else []
        scope += [f"Reads: {cell(', '.join(own['source_tables']))}"] if own.get("source_tables") else []
        out += [f"### {r.rule_id} {r.entity_name}.{r.column_name}", "", first_sentence(own.get("business_meaning") or ""), f"Effective from: {r.effective_dates}", *scope, "", explain(text), "", "```", laid_out(text) or text, "```", ""]
    out += ["## Tables", "", "| Table | Read by | Columns written |", "| --- | --- | --- |"]
    out += [f"| {cell(r.table)} | {cell(r.readers)} | {cell(r.columns)} |" for r in sorted(uses.collect(), key=lambda r: r.table)]
    return "\n".join(out) + "\n"
