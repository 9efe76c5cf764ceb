"""Stopping a call: its Spark jobs are cancelled, and rows that weren't written are neither successes nor failures."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from batchwright.result import NOT_ATTEMPTED, Result


class Cancelled(RuntimeError):
    """The call was stopped."""


class Cancellation:
    """Give it to the code that may stop a call; ``running`` marks the jobs that ``cancel`` ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.cancelled = spark, f"batchwright-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @contextmanager
    def running(self) -> Iterator[None]:
        if self.cancelled:
            raise Cancelled(self.tag)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield
        except Exception as error:
            if self.cancelled:
                raise Cancelled(self.tag) from error
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)


def not_attempted(result: Result) -> Result:
    """The result of a call that was stopped before its commit: no row was written, no table changes."""
    none = F.lit(None).cast("string")
    outcomes = result.outcomes.withColumns({"status": F.lit(NOT_ATTEMPTED), "reason": none, "message": none})
    return replace(result, outcomes=outcomes, state={})
