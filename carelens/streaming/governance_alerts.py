"""Structured Streaming form of the governance monitoring.

* ``sla_breach_alerts``: stateless filter of issues that are open or were
  resolved after their SLA target, the streaming twin of ``gov2_sla_breach``.
* ``weekly_issue_counts``: issues per Monday-aligned week (event-time tumbling
  window) with a watermark, so state for closed weeks is dropped and, in append
  mode, each week is emitted once it can no longer change.
* ``spc_over_weeks``: control limits over the weekly counts written by the
  stream (a batch read of the sink, reusing the batch SPC operator).

Sources are file streams of the raw issue rows (here: lineitem Parquet files
mapped by the adapter); sinks keep their checkpoints under the shared folder
named by ``spark.checkpoint.dir``, so a restarted query resumes exactly once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from carelens.operators import quality
from carelens.operators.stats import control_limits
from carelens.sources.adapters import governance_log_from

LINEITEM_COLUMNS = T.StructType([
    T.StructField("l_orderkey", T.LongType()),
    T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_shipdate", T.TimestampNTZType()),
])

WEEK = "7 days"
MONDAY_OFFSET = "4 days"    # epoch (1970-01-01) is a Thursday; +4 days aligns windows to Monday
DEFAULT_WATERMARK = "14 days"


def governance_stream(spark: SparkSession, source_dir: str, file_glob: str = "lineitem*.parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming governance log over the Parquet files arriving in ``source_dir``."""
    reader = (spark.readStream.schema(LINEITEM_COLUMNS)
              .option("pathGlobFilter", file_glob))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return governance_log_from(reader.parquet(source_dir))


def sla_breach_alerts(log: DataFrame) -> DataFrame:
    """Open issues and issues resolved after their SLA target (stateless)."""
    g = log.withColumn("sla_days", quality.sla_days("severity"))
    breached = F.col("days_to_resolve") > F.col("sla_days")
    return (g.where((F.col("resolved_flag") == 0) | ((F.col("resolved_flag") == 1) & breached))
             .select("issue_id", "table_name", "issue_type", "severity", "source_system",
                     "detected_date", "days_to_resolve", "sla_days",
                     F.when(breached, "SLA BREACHED").otherwise("WITHIN SLA").alias("sla_status")))


def weekly_issue_counts(log: DataFrame, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Issues per Monday-aligned week, with late rows accepted up to ``watermark``."""
    ts = F.col("detected_date").cast("timestamp")
    return (log.where(F.col("detected_date").isNotNull())
               .withColumn("detected_ts", ts)
               .withWatermark("detected_ts", watermark)
               .groupBy(F.window("detected_ts", WEEK, WEEK, MONDAY_OFFSET).alias("w"))
               .agg(F.count(F.lit(1)).alias("issues"))
               .select(F.col("w.start").cast("date").alias("week"), "issues"))


def start_alerts(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                 available_now: bool = True,
                 watermark: str = DEFAULT_WATERMARK) -> list[StreamingQuery]:
    """Start both alert streams into Parquet sinks under ``sink_dir``.
    Give the same ``checkpoint_dir`` (shared storage) again to resume exactly once
    after a restart. ``available_now`` processes what is there and stops (scheduled runs);
    otherwise the queries keep running."""
    log = governance_stream(spark, source_dir)
    queries = []
    for name, df in (("sla_breach_alerts", sla_breach_alerts(log)),
                     ("weekly_issue_counts", weekly_issue_counts(log, watermark))):
        writer = (df.writeStream.format("parquet").outputMode("append")
                  .option("path", os.path.join(sink_dir, name))
                  .option("checkpointLocation", os.path.join(checkpoint_dir, name)))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
        queries.append(writer.start())
    return queries


def spc_over_weeks(spark: SparkSession, weekly_dir: str) -> DataFrame:
    """Control limits over the weekly counts the stream has written so far."""
    return control_limits(spark.read.parquet(weekly_dir), "issues").orderBy("week")
