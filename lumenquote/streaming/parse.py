"""Parsing of answers as they arrive. Each answer is one row, so append mode needs no state but that against resent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumenquote.operators.protocol import claim_segments, parse_evidence


def answer_stream(spark: SparkSession, folder: str, schema: StructType, late: str = "7 days", files_per_trigger: int = 8) -> DataFrame:
    """Answers from files of a folder, resent ones dropped within the time that rows may be late."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", late).dropDuplicatesWithinWatermark(["answer_id"])


def evidence_stream(answers: DataFrame) -> DataFrame:
    return parse_evidence(answers.select("answer_id", "answer"))


def claim_stream(answers: DataFrame) -> DataFrame:
    return claim_segments(answers.select("answer_id", "answer"))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a folder; the checkpoint makes the files exactly-once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
