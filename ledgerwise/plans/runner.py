"""Jobs: submitted, run, looked up and exported, with their rows in a store."""

from __future__ import annotations

import datetime as dt
import logging
import os
import uuid
from collections.abc import Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import jobs
from ..sources import dictionary_csv
from ..sources.store import Store
from . import service

log = logging.getLogger("ledgerwise")
JOB = "job_id string, company string, platform string, status string, run_number bigint, report string, error string, updated_at timestamp, version bigint"
AUDIT = "job_id string, event string, detail string, at timestamp"


@dataclass(frozen=True)
class Settings:
    """What a runner is set up with; from the environment where it names a value."""

    folder: str = "ledgerwise-jobs"
    attempts: int = 2
    workers: int = 1
    log_level: str = "INFO"

    @classmethod
    def from_environment(cls, prefix: str = "LEDGERWISE_") -> Settings:
        found = {f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**{k: int(v) if k in ("attempts", "workers") else v for k, v in found.items()})


class Runner:
    """RUNNING, then COMPLETED, or FAILED with an audit row. Rows of the store are only appended; the last version of a job counts."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, model=None):
        self.spark, self.settings, self.model = spark, settings or Settings.from_environment(), model
        self.store = Store(spark, self.settings.folder)
        self.pool = ThreadPoolExecutor(self.settings.workers)
        logging.getLogger("py4j").setLevel(logging.WARNING)
        log.setLevel(self.settings.log_level)

    def _put(self, job: dict) -> None:
        now = dt.datetime.now()
        self.store.append("jobs", self.spark.createDataFrame([tuple({"updated_at": now, **job}.get(x.split()[0]) for x in JOB.split(", "))], JOB))

    def submit(self, files: Mapping[str, str], company: str, platform: str, **more) -> tuple[str, Future]:
        """A job's id, and what ends when it is done. Missing names raise before anything is stored."""
        if missing := [n for n, v in (("Company", company), ("Platform", platform)) if not (v or "").strip()]:
            raise ValueError(" and ".join(missing) + " required")
        number = 1
        if self.store.has("jobs"):
            number = jobs.next_run(self.store.read("jobs")).first().next_run
        job = {"job_id": uuid.uuid4().hex, "company": company, "platform": platform, "status": "RUNNING", "run_number": number, "version": 0}
        self._put(job)
        return job["job_id"], self.pool.submit(self._run, job, dict(files), more)

    def _run(self, job: dict, files: dict[str, str], more: dict) -> None:
        try:
            got = service.generate(self.spark, files, job["company"], job["platform"], model=self.model, attempts=self.settings.attempts, **more)
            rows = got.rows.withColumns({"job_id": F.lit(job["job_id"]), "row_index": F.col("pos"), "id": F.concat_ws("/", F.lit(job["job_id"]), F.col("pos")), "expression": F.col("display_derivation_expression")})
            self.store.append("dd_rows", rows)
            done = {"status": "COMPLETED", "report": got.report}
        except Exception as e:  # whatever stops a job is its result
            log.exception("job %s", job["job_id"])
            done = {"status": "FAILED", "error": str(e).split("\n")[0][:500]}
            self.store.append("audit_log", self.spark.createDataFrame([(job["job_id"], "FAILED", done["error"], dt.datetime.now())], AUDIT))
        self._put(job | done | {"version": 1})

    def jobs(self) -> DataFrame:
        """The last version of each job, newest first."""
        return jobs.listed(jobs.latest(self.store.read("jobs"), "job_id", "version"))

    def job(self, job_id: str):
        """A job as it is, or KeyError."""
        if (row := jobs.one(self.jobs(), "job_id", job_id).first()) is None:
            raise KeyError(job_id)
        return row

    def status(self, job_id: str) -> dict:
        """Status, error, and how many rows there are and wait for review."""
        job = self.job(job_id)
        count = jobs.status_counts(jobs.of_job(self.store.read("dd_rows"), job_id)).first() if job.status == "COMPLETED" else None
        return {"status": job.status, "error": job.error, "total": count.total if count else 0, "pending": count.pending if count else 0}

    def report(self, job_id: str) -> str:
        if (job := self.job(job_id)).status != "COMPLETED":
            raise ValueError(f"job {job_id} is {job.status}")
        return job.report

    def pending(self, job_id: str) -> DataFrame:
        return jobs.pending(jobs.of_job(self.store.read("dd_rows"), job_id))

    def decide(self, decisions: DataFrame) -> None:
        """Rows of row_id, decision_id, action and edited_expression."""
        self.store.append("review_decisions", decisions)

    def export(self, job_id: str) -> DataFrame:
        """The rows of a job that are active after review, in order, in the external form."""
        self.job(job_id)
        rows = self.store.read("dd_rows")
        none = self.spark.createDataFrame([], "row_id string, decision_id bigint, action string, edited_expression string")
        decisions = self.store.read("review_decisions") if self.store.has("review_decisions") else none
        return dictionary_csv.to_external(jobs.reviewed(rows, decisions, job_id))

    def write_report(self, job_id: str, path: str) -> None:
        """The report as a text file in a folder."""
        self.spark.createDataFrame([(self.report(job_id),)], "value string").coalesce(1).write.mode("overwrite").text(path)
