"""Streaming ingestion: files of a folder go into the engine, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.identity import document_id
from lodestone.plans.engine import Engine
from lodestone.sources.files import SUPPORTED, extension, name_of


def file_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """filename and content of the supported files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)
    rows = rows.where(extension(F.col("path")).isin(*SUPPORTED) & (F.col("length") > 0))
    return rows.select(name_of(F.col("path")).alias("filename"), "content")


def start(engine: Engine, folder: str, checkpoint: str, available_now: bool = True):
    """Run the stream into the engine. A batch that is repeated after a failure adds nothing twice, as ids are of content."""
    writer = file_stream(engine.spark, folder).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, _: engine.ingest(batch))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def registry_stream(documents: DataFrame) -> DataFrame:
    """The first row of each document id in a stream of (ts, filename, content); ids are kept for a day of event time."""
    rows = documents.withColumn("document_id", document_id("content")).withWatermark("ts", "1 day")
    return rows.dropDuplicatesWithinWatermark(["document_id"]).select("document_id", "filename", "ts")
