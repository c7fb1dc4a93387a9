"""The dictionary's CSV form: ten columns in fixed order, dates as dd-MM-yyyy."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Header and field of each column, in order.
COLUMNS = {
    "Entity Name": "entity_name",
    "Column Name": "column_name",
    "Column Type": "column_type",
    "Derivation Option": "derivation_option",
    "Display Derivation Expression": "display_derivation_expression",
    "Effective Start Date": "effective_start_date",
    "Status": "status",
    "Data Type": "data_type",
    "Decision Table Json": "decision_table_json",
    "Conditional Json": "conditional_json",
}
_DATE = "effective_start_date"


def to_external(rows: DataFrame) -> DataFrame:
    """Dictionary rows as ten texts; missing values are empty."""
    text = lambda f: F.date_format(f, "dd-MM-yyyy") if f == _DATE else F.col(f).cast("string")
    return rows.select(*((F.coalesce(text(f), F.lit("")) if f in rows.columns else F.lit("")).alias(h) for h, f in COLUMNS.items()))


def from_external(rows: DataFrame) -> DataFrame:
    text = lambda h: F.coalesce(F.col(f"`{h}`"), F.lit("")) if h in rows.columns else F.lit("")
    return rows.select(*((F.try_to_date(text(h), "dd-MM-yyyy") if f == _DATE else text(h)).alias(f) for h, f in COLUMNS.items()))


def write(rows: DataFrame, path: str) -> None:
    """Dictionary rows as CSV with a header; the dictionary is metadata, one file."""
    to_external(rows).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of such CSV; a path that isn't there gives none."""
    schema = ", ".join(f"`{h}` string" for h in COLUMNS)
    try:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        raw = spark.createDataFrame([], schema)
    return from_external(raw.toDF(*(c.lstrip("﻿") for c in raw.columns)))
