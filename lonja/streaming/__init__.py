"""The exact match as a stream: invoice lines arrive as files, the catalogue stays a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lonja.operators.catalogue import exact_matches


def matched_lines(spark: SparkSession, folder: str, schema: str, master: DataFrame, equivalents: DataFrame) -> DataFrame:
    """Lines (ruc, code and more) from new files of a folder, with the result of `exact_matches`; keeps no state."""
    return exact_matches(spark.readStream.schema(schema).parquet(folder), master, equivalents)


def write_matches(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived so far to path and ends; files once read are not read again."""
    return lines.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
