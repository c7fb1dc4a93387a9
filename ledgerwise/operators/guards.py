"""Guardrails as arrays of errors; an empty array is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrow import each
from ..functions.lint import grammar

#: Size limit, file ending, phrases that SQL files don't hold.
MAX_BYTES = 10 * 1024 * 1024
ENDING = ".sql"
PHRASES = ("ignore previous instructions", "disregard all prior", "system prompt")


def _errors(*tests: tuple[Column, str | Column]) -> Column:
    each = F.array(*(F.when(t, F.lit(m) if isinstance(m, str) else m) for t, m in tests))
    return F.filter(each, lambda e: e.isNotNull())


def input_errors(name: str | Column, text: str | Column) -> Column:
    name, text = (F.col(c) if isinstance(c, str) else c for c in (name, text))
    text = F.coalesce(text, F.lit(""))
    size = F.octet_length(text)
    return _errors(
        (~F.lower(F.coalesce(name, F.lit(""))).endswith(ENDING), F.concat(F.lit("Unsupported file type: "), F.coalesce(name, F.lit("")))),
        (size > MAX_BYTES, F.concat(F.lit("File exceeds max size ("), size.cast("string"), F.lit(f" > {MAX_BYTES} bytes)"))),
        (~text.rlike(r"\S"), "File is empty"),
        *((F.contains(F.lower(text), F.lit(p)), f"Suspicious content detected: '{p}'") for p in PHRASES),
    )


def job_errors(company: str, platform: str) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return _errors((blank(company), "Company is required"), (blank(platform), "Platform is required"))


def structure_errors(least: float = 0.5) -> Column:
    """Over rows of plans.statements.object_rollup()."""
    return _errors(
        (F.col("confidence") < least, "Low structural confidence"),
        (F.col("has_dynamic_sql"), "Dynamic SQL"),
        (F.col("unparsed") > 0, F.concat(F.col("unparsed").cast("string"), F.lit(" statements can't be parsed"))),
        (F.col("chunks") == 0, "No chunks"),
        (F.size("tables_read") + F.size("tables_written") == 0, "No tables"),
    )


def output_errors() -> Column:
    """Over dictionary rows with an array grammar_errors."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    table = F.col("derivation_option") == "Decision Table"
    return F.concat(
        F.when(table, F.array().cast("array<string>")).otherwise(F.col("grammar_errors")),
        _errors((table & blank("decision_table_json"), "Decision table is empty"), (blank("entity_name"), "Entity is missing"), (blank("column_name"), "Column is missing")),
    )


def grammar_errors(text: str | Column) -> Column:
    """The grammar's findings on a formula."""
    return each(grammar, "array<string>")(text)


def unknown_words(rows: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key and n, the number of distinct words of a text that no row of known (w) holds; one anti-join on words."""
    words = rows.select(key, F.explode(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), " "))).alias("w"))
    new = words.join(known.select("w").distinct(), "w", "left_anti").groupBy(key).agg(F.count("*").alias("n"))
    return rows.select(key).join(new, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def invented_tokens(rows: DataFrame, tokens: str, source: str) -> DataFrame:
    """rows with the sorted tokens that the array `source` doesn't hold."""
    return rows.withColumn("invented", F.array_sort(F.array_distinct(F.array_except(tokens, source))))
