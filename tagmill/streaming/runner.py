"""Runs the job table: claims jobs by kind, hands them to a handler, records what came of it.

A handler gets the claimed rows as a DataFrame and returns new jobs (kind, payload, and
optionally run_id, priority, max_attempts) or None; it works on all of them at once. The
table is a store of generations, so a runner that dies leaves the claim to its lease.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.sources import export
from tagmill.streaming import jobs


def clock() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Runner:
    def __init__(self, spark: SparkSession, path: str, handlers: dict[str, Callable[[DataFrame], DataFrame | None]], worker: str = "worker", batch: int = 100, lease_seconds: int = 300, retry_seconds: int = 30, now: Callable[[], datetime] = clock):
        self.spark, self.path, self.handlers, self.worker = spark, path, dict(handlers), worker
        self.batch, self.lease, self.retry, self.now = batch, lease_seconds, retry_seconds, now

    def table(self) -> DataFrame:
        return export.read_store(self.spark, self.path, "jobs")

    def log(self) -> DataFrame:
        return export.read_store(self.spark, self.path, "events")

    def write(self, after: DataFrame) -> None:
        """The next generation of the table, and the log with what changed."""
        before, log, generation = self.table(), self.log(), export.manifest(self.spark, self.path)["generation"]
        export.write_store({"jobs": after, "events": log.unionByName(jobs.events(before, after))}, self.path, generation + 1)

    def start(self, first: DataFrame) -> None:
        """A new store with first jobs (job_id, kind, payload, ...)."""
        none = self.spark.createDataFrame([], jobs.SCHEMA)
        after = jobs.enqueue(none, first, self.now())
        export.write_store({"jobs": after, "events": jobs.events(none, after)}, self.path, 0)

    def add(self, table: DataFrame, new: DataFrame) -> DataFrame:
        last = table.agg(F.max("job_id")).first()[0] or 0
        order = Window.orderBy("kind", "payload")  # what one batch asks for
        return jobs.enqueue(table, new.withColumn("job_id", F.row_number().over(order).cast("long") + F.lit(last)), self.now())

    def run_once(self) -> int:
        """Claims and runs up to a batch of jobs of the kind that is due first; their number."""
        table, now = self.table(), self.now()
        due = jobs.next_jobs(table, now, 1, list(self.handlers)).first()
        if due is None:
            return 0
        self.write(jobs.claim(table, now, self.worker, self.lease, self.batch, [due.kind]))
        table = self.table()
        mine = (F.col("locked_by") == self.worker) & (F.col("state") == jobs.LEASED) & (F.col("kind") == due.kind)
        claimed = table.where(mine)
        n = claimed.count()
        try:
            new = self.handlers[due.kind](claimed)
            after = jobs.complete_all(table, mine, self.now())
            self.write(after if new is None else self.add(after, new))
        except Exception as error:  # the job's failure is a result: it is recorded and tried again
            self.write(jobs.fail_all(table, mine, f"{type(error).__name__}: {error}".splitlines()[0], self.now(), self.retry))
        return n

    def run_until_empty(self, most: int | None = None) -> int:
        done = 0
        while (most is None or done < most) and (n := self.run_once()):
            done += n
        return done
