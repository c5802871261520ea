"""Spark event logs as a table of queries: text, plan, duration, task metrics and the materialized views they read."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = """
    Event string, executionId bigint, description string, physicalPlanDescription string, `time` bigint,
    `Stage ID` bigint, `Job ID` bigint, `Stage IDs` array<bigint>, Properties map<string,string>,
    `Task Info` struct<`Launch Time`: bigint, `Finish Time`: bigint, Failed: boolean>,
    `Task Metrics` struct<`Executor Run Time`: bigint, `Executor CPU Time`: bigint, `JVM GC Time`: bigint, `Peak Execution Memory`: bigint, `Disk Bytes Spilled`: bigint,
        `Input Metrics`: struct<`Bytes Read`: bigint, `Records Read`: bigint>, `Output Metrics`: struct<`Bytes Written`: bigint, `Records Written`: bigint>,
        `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>>"""
_SQL = "org.apache.spark.sql.execution.ui."


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events of one or more logs, under a fixed schema: fields that are not asked for are not parsed."""
    return spark.read.schema(_SCHEMA).json(path)


def queries(spark: SparkSession, path: str, views: list[str] | None = None, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """A row a query: execution_id, description, plan, started, seconds, tasks, failed_tasks, run_seconds, gc_seconds, peak_bytes, rows_read, shuffle_bytes, spilled_bytes, views.

    since_ms and until_ms bound the start.  Queries that did not end have no
    seconds; those without tasks have zeros.  views: those of the given names
    whose table occurs in the plan.
    """
    e = events(spark, path)
    start = e.where(F.col("Event") == f"{_SQL}SparkListenerSQLExecutionStart").select(
        F.col("executionId").alias("execution_id"), "description", F.col("physicalPlanDescription").alias("plan"), F.col("time").alias("started_ms")
    )
    if since_ms is not None:
        start = start.where(F.col("started_ms") >= since_ms)
    if until_ms is not None:
        start = start.where(F.col("started_ms") < until_ms)
    end = e.where(F.col("Event") == f"{_SQL}SparkListenerSQLExecutionEnd").groupBy(F.col("executionId").alias("execution_id")).agg(F.max("time").alias("ended_ms"))
    jobs = e.where(F.col("Event") == "SparkListenerJobStart").select(
        F.col("Properties")["spark.sql.execution.id"].cast("long").alias("execution_id"), F.explode("Stage IDs").alias("stage")
    )
    of_stage = jobs.where("execution_id is not null").groupBy("stage").agg(F.min("execution_id").alias("execution_id"))
    m = F.col("Task Metrics")
    tasks = e.where(F.col("Event") == "SparkListenerTaskEnd").select(
        F.col("Stage ID").alias("stage"), F.col("Task Info.Failed").alias("failed"), m["Executor Run Time"].alias("run"), m["JVM GC Time"].alias("gc"), m["Peak Execution Memory"].alias("peak"),
        m["Input Metrics"]["Records Read"].alias("rows"), m["Shuffle Write Metrics"]["Shuffle Bytes Written"].alias("shuffled"), m["Disk Bytes Spilled"].alias("spilled"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = tasks.join(of_stage, "stage").groupBy("execution_id").agg(
        F.count("*").alias("tasks"), F.count_if("failed").alias("failed_tasks"), (total("run") / 1000).alias("run_seconds"), (total("gc") / 1000).alias("gc_seconds"),
        F.coalesce(F.max("peak"), F.lit(0)).alias("peak_bytes"), total("rows").alias("rows_read"), total("shuffled").alias("shuffle_bytes"), total("spilled").alias("spilled_bytes"),
    )
    out = start.join(end, "execution_id", "left").join(sums, "execution_id", "left")
    zeros = {c: 0 for c in ("tasks", "failed_tasks", "run_seconds", "gc_seconds", "peak_bytes", "rows_read", "shuffle_bytes", "spilled_bytes")}
    names = [v.replace("`", "") for v in views or []]
    plain = F.regexp_replace("plan", "`", "")
    # whole names only: hr.v is not read where hr.v2 is
    read = lambda n: plain.rlike(r"(?<!\w)" + re.escape(n) + r"(?!\w)")
    used = F.filter(F.array(*(F.when(read(n), F.lit(n)) for n in names)), lambda v: v.isNotNull()) if names else F.array().cast("array<string>")
    return out.fillna(zeros).select(
        "execution_id", "description", "plan", F.timestamp_millis("started_ms").alias("started"), ((F.col("ended_ms") - F.col("started_ms")) / 1000).alias("seconds"), *zeros, used.alias("views")
    )


def main(arguments: list[str] | None = None) -> None:
    """python -m tessella.mv.eventlog LOGS OUT [--views a.v,b.w] [--since MS] [--until MS]: the table of queries as JSON files."""
    parser = argparse.ArgumentParser(description="Spark event logs as a table of queries")
    parser.add_argument("logs")
    parser.add_argument("out")
    parser.add_argument("--views", default="")
    parser.add_argument("--since", type=int)
    parser.add_argument("--until", type=int)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("event logs").getOrCreate()
    queries(spark, a.logs, [v for v in a.views.split(",") if v], a.since, a.until).write.mode("overwrite").json(a.out)


if __name__ == "__main__":
    main()
