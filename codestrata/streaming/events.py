"""Streams of jobs and logs; every transform is the batch transform as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import incremental as I


def counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by time window and type, late rows within the watermark included."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job from its events."""
    return I.job_states(events)


def filter_logs(logs: DataFrame, levels: list[str] | None = None, component: str | None = None, task: str | None = None, search: str | None = None) -> DataFrame:
    """Log rows by level, component, task and text."""
    if levels:
        logs = logs.where(F.col("level").isin(*levels))
    if component:
        logs = logs.where(F.col("component") == component)
    if task:
        logs = logs.where(F.col("task_id") == task)
    return logs.where(F.col("message").ilike(f"%{search}%")) if search else logs


def parse_logs(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON log lines to level, component, message, task_id; the component is the bracketed head of the message."""
    j = F.from_json(text, "struct<level:string,msg:string,time:string,taskId:string>")
    head = F.regexp_extract("j.msg", r"^\[?([\w-]+)[\]:]", 1)
    return lines.select(j.alias("j")).where("j.msg is not null").select(F.coalesce("j.level", F.lit("info")).alias("level"), F.when(head == "", "app").otherwise(head).alias("component"), F.col("j.msg").alias("message"), F.col("j.taskId").alias("task_id"), F.col("j.time").alias("time"))


def run_available(spark: SparkSession, folder: str, transform, schema, name: str, checkpoint: str) -> DataFrame:
    """Runs ``transform`` over all files of a folder as a stream and returns the final table."""
    stream = transform(spark.readStream.schema(schema).parquet(folder))
    q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
