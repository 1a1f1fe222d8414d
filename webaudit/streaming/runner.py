"""Reading streams of files, and running a stream over what is there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import scratch_path


def read_stream(spark: SparkSession, directory: str, schema: str | StructType,
                name: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a directory as they land, or those of the table ``name`` in it.

    ``name`` may be a pattern; what it names may be files, or folders with the files in them.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    # A path without a pattern would have to be a folder; one in brackets matches itself alone.
    return reader.parquet(f"{directory}/{name if '*' in name else re.sub('[.]', '[.]', name)}")


def run_available(stream: DataFrame, name: str, mode: str = "append",
                  output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all data there is, then read the result back.

    Results and checkpoints are written to the shared folder, never to the driver; a restart
    with the same paths goes on where the last run stopped.
    """
    spark = stream.sparkSession
    output = output or scratch_path(spark, f"{name}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-state")
    run = (stream.writeStream.format("parquet").outputMode(mode)
           .option("checkpointLocation", checkpoint).option("path", output)
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(output)
