"""Record files -> per-batch partial cell rollups -> combined rollup."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curbscope.operators.clean import add_hex_id, clean_violations
from curbscope.operators.rollup import cell_rollup, merged
from curbscope.schema import RAW_SCHEMA
from curbscope.sources.events import violations_from_events
from curbscope.sources.violations import _check_columns, _project, header_schema


def violation_stream(spark: SparkSession, source: str, fmt: str = "csv",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of raw violation files (typed schema, no inference).

    CSV columns are bound by the header of the files that are there when the
    stream starts (the raw columns in their fixed order if there are none);
    a later file with another header fails the query instead of being bound
    by position."""
    schema = RAW_SCHEMA
    if fmt == "csv":
        try:
            header = spark.read.option("header", True).option("escape", '"').csv(source).columns
        except AnalysisException:
            header = []
        if header:
            _check_columns(header, source)
            schema = header_schema(header)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if fmt == "csv":
        reader = (reader.option("header", True).option("escape", '"')
                  .option("enforceSchema", False))
    return _project(reader.format(fmt).load(source))


def event_stream(spark: SparkSession, sf_dir: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw violations derived from the driver ``events`` table, as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return violations_from_events(reader.parquet(sf_dir))


def write_partial_rollup(batch: DataFrame, batch_id: int, path: str, resolution: int = 9) -> None:
    """One micro-batch -> its partial rollup in partition ``batch_id``.
    Dynamic partition overwrite makes a replayed batch replace its own
    output instead of duplicating it."""
    partial = cell_rollup(add_hex_id(clean_violations(batch), resolution))
    (partial.withColumn("batch_id", F.lit(int(batch_id)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def start_rollup_stream(raw_stream: DataFrame, rollup_path: str, checkpoint_location: str,
                        resolution: int = 9, available_now: bool = True) -> StreamingQuery:
    writer = (raw_stream.writeStream
              .foreachBatch(lambda df, epoch: write_partial_rollup(df, epoch, rollup_path,
                                                                   resolution))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()


def combined_rollup(spark: SparkSession, rollup_path: str) -> DataFrame:
    """Sum the partial rollups of all batches into one cell rollup."""
    return merged(spark.read.parquet(rollup_path))
