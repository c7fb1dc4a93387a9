"""Version thresholds in procedure text, and the periods that they cut."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

#: What a threshold looks like (a prefix of the key is optional), and day 0 of unmapped keys.
THRESHOLD = r"(?i)((?:\b[a-z_]\w*|@|\b)TIMEKEY)\s*(>=|<=|>|<|=)\s*(\d+)"
DAY_ZERO = dt.date(2000, 1, 1)


def thresholds(objects: DataFrame) -> DataFrame:
    """object_id, pos, variable, operator, value, raw_condition of every version test in raw_sql, in order."""
    part = lambda i: F.regexp_extract("raw", THRESHOLD, i)
    found = objects.select("object_id", F.posexplode(F.regexp_extract_all("raw_sql", F.lit(THRESHOLD), 0)).alias("pos", "raw"))
    return found.select("object_id", "pos", part(1).alias("variable"), part(2).alias("operator"), part(3).cast("bigint").alias("value"), F.col("raw").alias("raw_condition"))


def by_variable(found: DataFrame) -> DataFrame:
    """object_id, variable, and its thresholds in order of value."""
    return found.groupBy("object_id", F.upper("variable").alias("variable")).agg(F.array_sort(F.collect_list(F.struct("value", "pos", "operator"))).alias("thresholds"))


def dated(keys: DataFrame, days: DataFrame, key: str = "value") -> DataFrame:
    """keys with effective_date and is_real: mapped by days (time_key, date), else counted from DAY_ZERO."""
    days = days.select(F.col("time_key").alias("_k"), F.col("date").alias("_d"))
    return keys.join(days, F.col(key) == F.col("_k"), "left").withColumns({"effective_date": F.coalesce("_d", F.date_add(F.lit(DAY_ZERO), F.col(key).cast("int"))), "is_real": F.col("_d").isNotNull()}).drop("_k", "_d")


def periods(found: DataFrame, days: DataFrame) -> DataFrame:
    """object_id, value, variable (the first seen), representative (value + 1), effective_date, is_real."""
    each = found.groupBy("object_id", "value").agg(F.min_by("variable", "pos").alias("variable")).withColumn("representative", F.col("value") + 1)
    return dated(each, days)


def fan_out(rows: DataFrame, cut: DataFrame, today: dt.date) -> DataFrame:
    """rows, one for each period of their object; without any, one from today."""
    out = rows.join(cut.select("object_id", "variable", "representative", "effective_date"), "object_id", "left")
    return out.withColumn("effective_date", F.coalesce("effective_date", F.lit(today)))
