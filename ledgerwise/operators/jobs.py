"""Queries over the job store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .steps import numbered


def next_run(jobs: DataFrame) -> DataFrame:
    return jobs.agg((F.coalesce(F.max("run_number"), F.lit(0)) + 1).alias("next_run"))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: an upsert read back from an append-only log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*(c for c in log.columns if c != key)), order).alias("r")).select(key, "r.*")


def patched(jobs: DataFrame, changes: DataFrame, key: str = "job_id") -> DataFrame:
    """Each column of changes where it isn't NULL, else the old value."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in changes.columns if c != key))
    out = jobs.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in changes.columns if c != key}).select(jobs.columns)


def pending(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'PENDING_REVIEW'").orderBy("id")


def of_job(rows: DataFrame, job_id: str) -> DataFrame:
    return rows.where(F.col("job_id") == job_id).orderBy("row_index", "id")


def one(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows with a key's value."""
    return rows.where(F.col(key) == F.lit(value))


def reviewed(rows: DataFrame, decisions: DataFrame, job_id: str) -> DataFrame:
    """A job's rows that are active after review, in order, for the export."""
    done = decided(of_job(rows, job_id), decisions).where("status = 'ACTIVE'")
    return done.withColumn("display_derivation_expression", F.col("expression")).orderBy("row_index", "id")


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "PENDING_REVIEW").alias("pending"))


def listed(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.coalesce("run_number", F.lit(0)).desc(), F.col("updated_at").desc())


def backfilled(jobs: DataFrame) -> DataFrame:
    """Run numbers by (created_at, job_id)."""
    return numbered(jobs.drop("run_number"), ["created_at", "job_id"], "run_number")


def decided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows after the last decision on each: APPROVE, EDIT and OVERRIDE make it ACTIVE, REJECT INACTIVE; EDIT replaces the expression."""
    last = decisions.groupBy("row_id").agg(F.max_by(F.struct("action", "edited_expression"), "decision_id").alias("d"))
    out = rows.join(last, rows["id"] == last["row_id"], "left")
    status = F.when(F.col("d.action") == "REJECT", "INACTIVE").when(F.col("d.action").isNotNull(), "ACTIVE").otherwise(F.col("status"))
    text = F.when(F.col("d.action") == "EDIT", F.coalesce("d.edited_expression", "expression")).otherwise(F.col("expression"))
    return out.withColumns({"status": status, "expression": text}).select(rows.columns)


def review_items(rows: DataFrame) -> DataFrame:
    return pending(rows.withColumn("validation_errors", F.from_json("validation_errors", "array<string>")))


def output_dir(run: str, job: str):
    return F.format_string("%03d_%s", run, job)
