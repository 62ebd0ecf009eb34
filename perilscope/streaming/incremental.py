"""Incremental totals and rebuild-on-arrival (see the package docstring)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scale import merge_moments, moments
from ..plans.builders import hazard_total, impact_logs, impact_of_logs
from ..session import stage_path


def read_stream(spark: SparkSession, path: str, like: DataFrame,
                fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A file-source stream with the schema of ``like`` (no inference)."""
    r = spark.readStream.schema(like.schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def totals_stream(measures: DataFrame, period_size: int | None = None,
                  min_events: int = 1) -> DataFrame:
    """C2 on a stream of long measures ``(country, year, hazard, affected,
    death)``: running per-(country, period, hazard) sums and counts kept in
    the state store; the event filter applies to the running counts."""
    return hazard_total(measures, period_size=period_size, min_events=min_events)


def run_available(stream: DataFrame, out_path: str, checkpoint: str,
                  mode: str = "complete") -> StreamingQuery:
    """Process everything available now, then stop (``availableNow``).

    Each micro-batch overwrites ``out_path`` with the current result
    (complete mode), so a retried batch rewrites the same output.
    """
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (stream.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def rebuild_on_arrival(stream: DataFrame, raw_path: str, out_path: str,
                       build: Callable[[DataFrame], DataFrame],
                       checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch of raw rows under ``raw_path/epoch=<id>``
    (overwriting that epoch's folder, so a retried batch is idempotent),
    then rebuild ``out_path`` from all raw rows received so far — the
    reference's "re-run the script on new files", driven by arrival."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{raw_path}/epoch={epoch_id}")
        spark = batch.sparkSession
        everything = spark.read.parquet(raw_path).drop("epoch")
        build(everything).write.mode("overwrite").parquet(out_path)

    w = (stream.writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def stream_paths(spark: SparkSession, name: str) -> dict[str, str]:
    """Output, raw and checkpoint folders under the shared checkpoint folder."""
    base = stage_path(spark, name)
    return {"out": f"{base}/out", "raw": f"{base}/raw", "checkpoint": f"{base}/_chk"}


# -- impacts that are kept up to date ---------------------------------------------

LOGS = ["_a_log", "_d_log"]
IMPACT_KEYS = ["country", "period", "hazard"]
LOGS_SCHEMA = "country string, hazard string, _a_log double, _d_log double, period int"
PART = "struct<n: bigint, mean: double, m2: double>"
MOMENTS_SCHEMA = f"hazard string, _a_log {PART}, _d_log {PART}, period int"


def update_impacts(measures: DataFrame, store: str) -> None:
    """Takes in all measure rows of some years (new years, or years told anew).

    Under ``store`` two tables are kept by period: the logarithms of the groups'
    means, and their moments per hazard. Only the periods that arrive are
    replaced, so the cost is that of the new rows, not of all; a repeated call
    with the same rows changes nothing."""
    logs = impact_logs(measures, IMPACT_KEYS)

    def keep(df: DataFrame, name: str) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("period").parquet(f"{store}/{name}"))

    keep(logs, "logs")
    spark = measures.sparkSession
    periods = measures.select(F.col("year").alias("period")).distinct()
    kept = spark.read.schema(LOGS_SCHEMA).parquet(f"{store}/logs").join(
        periods, "period", "left_semi")
    keep(moments(kept, LOGS, ["hazard", "period"]), "moments")


def kept_impacts(spark: SparkSession, store: str) -> DataFrame:
    """C1 from the kept tables: the periods' moments are merged (a few rows per
    hazard and period) and every group is scaled by them; no raw row is read."""
    parts = spark.read.schema(MOMENTS_SCHEMA).parquet(f"{store}/moments")
    logs = spark.read.schema(LOGS_SCHEMA).parquet(f"{store}/logs")
    return impact_of_logs(logs, IMPACT_KEYS, ["hazard"],
                          fitted=merge_moments(parts, LOGS, ["hazard"]))
