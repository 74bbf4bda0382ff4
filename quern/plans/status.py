"""What Spark says of a job group or a stream, for the monitor."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.jdbc import retried


def job_state(spark: SparkSession, group: str) -> str:
    """RUNNING, COMPLETED, FAILED or UNKNOWN, from the jobs that ran in the group of this name, which the runner sets beside the tag."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    states = {j.status for j in jobs if j is not None}
    for state, name in (("RUNNING", "RUNNING"), ("FAILED", "FAILED"), ("SUCCEEDED", "COMPLETED")):
        if state in states:
            return name
    return "UNKNOWN"


def stream_state(query: StreamingQuery) -> str:
    if query.isActive:
        return "RUNNING"
    return "FAILED" if query.exception() is not None else "COMPLETED"


def confirmed(state, expected: str, tries: int = 5, wait: float = 1.0) -> bool:
    """Whether ``state()`` is ``expected`` within some tries."""

    def look() -> bool:
        if state() != expected:
            raise LookupError(expected)
        return True

    try:
        return retried(look, tries, wait)
    except LookupError:
        return False
