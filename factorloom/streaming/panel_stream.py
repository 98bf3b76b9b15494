"""The two append-only feeds as file streams: the IC log and panel rows.

Both are idempotent: a batch that is replayed after a failure gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ingest import dedup_keep, upsert

IC_LOG = T.StructType(
    [T.StructField("factor_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("rank_ic", T.DoubleType())]
)


def append_ic(rows: DataFrame, log_path: str) -> None:
    """Append one run's factor ICs to the log."""
    rows.select("factor_id", "date", "rank_ic").write.mode("append").parquet(log_path)


def ic_log_stream(spark: SparkSession, log_path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(IC_LOG)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(log_path)


def running_ic(stream: DataFrame) -> DataFrame:
    """Running count, mean and newest date of each factor's IC."""
    return stream.groupBy("factor_id").agg(
        F.count("rank_ic").alias("n"), F.avg("rank_ic").alias("mean_ic"), F.max("date").alias("last_date")
    )


def run_ic_log(spark: SparkSession, log_path: str, checkpoint: str, out_path: str, files_per_batch: int | None = None):
    """Keep a table of running IC statistics; each batch replaces it whole (one row per factor)."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    stats = running_ic(ic_log_stream(spark, log_path, files_per_batch))
    return (
        stats.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def run_panel_upsert(spark: SparkSession, schema: T.StructType, in_path: str, table_path: str, checkpoint: str, files_per_batch: int | None = None, arrived: str | None = None):
    """Merge arriving panel rows into a table laid out by month; newer rows win per (date, asset).

    Within a batch the row with the largest ``arrived`` wins; without that column, the largest row.

    Only the months a batch touches are read and rewritten, through dynamic partition
    overwrite.  The merged rows are written to a side folder first, because Spark cannot
    overwrite the files it is reading.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(in_path)

    def merge(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        new = batch.withColumn("month", F.date_format("date", "yyyy-MM"))
        new = dedup_keep(new, ["date", "asset"], [arrived], last=True) if arrived else upsert(new, new.limit(0))
        table = session.createDataFrame([], new.schema)
        if _exists(session, table_path):
            months = new.select("month").distinct()
            table = session.read.schema(new.schema).parquet(table_path).join(F.broadcast(months), "month", "left_semi")
        staged = f"{checkpoint}/staged/{epoch}"
        upsert(table.select(*new.columns), new).write.mode("overwrite").parquet(staged)
        (
            session.read.parquet(staged)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("month")
            .parquet(table_path)
        )

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
    )


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).limit(0).count()
        return True
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return False
        raise
