"""Each new export file becomes calls once (STR1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pool import dedupe_kit
from ..sources.arrays import parse_array_exports

CALLS = "sample_id string, kit string, rsid string, chromosome string, position long, allele1 string, allele2 string, provider string, batch long"


def ingest_stream(spark: SparkSession, path: str, calls_path: str, refused_path: str, checkpoint: str):
    """Start a query that takes the files now under ``path`` (named ``<sample>__<kit>.txt``) and stops.

    Each batch writes the calls of its files, repeats within a kit resolved, to a partition of its own that a retry
    replaces; files without a usable header go to ``refused_path``.  ``current_calls`` reads the state.
    """
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("line"))

    def take(batch: DataFrame, batch_id: int) -> None:
        calls, refused = parse_array_exports(batch)
        name = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
        rows = calls.select(F.split(name, "__")[0].alias("sample_id"), F.coalesce(F.get(F.split(name, "__"), F.lit(1)), F.lit("")).alias("kit"), "rsid", "chromosome", "position", "allele1", "allele2", "provider", F.struct("position", "allele1", "allele2").alias("seq"))
        for frame, where in ((dedupe_kit(rows).drop("seq"), calls_path), (refused, refused_path)):
            frame.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(where)

    return lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_calls(spark: SparkSession, calls_path: str) -> DataFrame:
    """All calls taken so far, the newest upload of a kit's marker first in line only where older ones have none."""
    rows = spark.read.schema(CALLS).parquet(calls_path)
    return dedupe_kit(rows.withColumn("seq", F.col("batch")))
