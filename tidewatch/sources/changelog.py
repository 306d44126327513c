"""Change-event sources: raw log records and parsed change envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = "value string, partition int, offset bigint, timestamp timestamp"

ORDER_ROW = (
    "struct<id:string,run_id:string,order_no:string,store_id:string,channel:string,items:string,"
    "amount:string,status:string,event_time:bigint,created_at:string,updated_at:string>"
)
SOURCE_ROW = "struct<server_id:int,file:string,pos:bigint,row:int>"


def raw_kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """A topic from its beginning: text payload with partition, offset and time."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.decode("value", "UTF-8").alias("value"), "partition", "offset", "timestamp"
    )


def raw_file_stream(spark: SparkSession, path: str, max_files: int | None = None, fmt: str = "json") -> DataFrame:
    """The same columns from a folder of files, for tests and replays."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def parse_changes(raw: DataFrame, row_type: str = ORDER_ROW) -> DataFrame:
    """Change envelopes of raw records; malformed payloads fail the job."""
    envelope = f"op string, ts_ms bigint, before {row_type}, after {row_type}, source {SOURCE_ROW}"
    event = F.from_json("value", envelope, {"mode": "FAILFAST"})
    # one-element explode: later filters stay above it, so a payload is parsed once
    parsed = raw.filter(F.col("value").isNotNull()).select(
        F.explode(F.array(event)).alias("event"), "partition", "offset", "timestamp"
    )
    return parsed.select("event.*", "partition", "offset", "timestamp")


def image(changes: DataFrame) -> DataFrame:
    """The row each change speaks of: the old one for a delete, else the new one."""
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    return changes.filter(F.col("op").isin("c", "u", "d", "r")).withColumn("row", row)
