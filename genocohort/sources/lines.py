"""Text files as rows with a file and a place.

A line's place comes from the file: files are read whole per split by Spark, so the place is
counted from the byte order that one task sees.  ``wholetext`` rows keep a file in one task; use
them only for files that fit, such as maps, chains and panel labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of every line; order within a file is not kept."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, line`` with the line's number; for files small enough for one row each."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return whole.where("line <> ''")


def read_table(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], mandatory: tuple[str, ...] = (), sep: str = "\t") -> DataFrame:
    """Delimited files with a header, columns found by any of their names; missing ones are null, a missing mandatory one an error."""
    raw = spark.read.csv(path, sep=sep, header=True)
    by_name = {c.strip().lstrip("#").lower(): c for c in raw.columns}

    def pick(names: tuple[str, ...]):
        found = [F.nullif(F.trim(F.col(f"`{by_name[n.lower()]}`")), F.lit("")) for n in names if n.lower() in by_name]
        return F.coalesce(*found) if found else None

    columns = {name: pick(names) for name, names in aliases.items()}
    lost = [m for m in mandatory if columns.get(m) is None]
    if lost:
        raise ValueError(f"no column for {', '.join(lost)} in {path}")
    return raw.select(*[(c if c is not None else F.lit(None).cast("string")).alias(name) for name, c in columns.items()])
