"""Reading raw drops, writing tables, reports and key=value artefacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.sources.layouts import LAYOUTS


def read_drop(spark: SparkSession, table: str, path: str, fmt: str = "csv", columns: Sequence[str] | None = None) -> DataFrame:
    """One raw drop with its declared layout; nothing is inferred by a data pass."""
    reader = spark.read.schema(LAYOUTS[table])
    df = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def union_drops(drops: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of all drops, tagged with the drop they came from in ``source``."""
    return reduce(
        lambda a, b: a.unionByName(b),
        [df.withColumn("source", F.lit(tag)) for tag, df in drops.items()],
    )


def _folder(location: str) -> str:
    """Path part of a file or folder address, with one slash at its end."""
    return "/" + urlparse(location).path.strip("/") + "/"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write parquet to a path the plan does not read from."""
    target = _folder(path)
    if any(_folder(f).startswith(target) for f in df.inputFiles()):
        raise ValueError(f"{path} is an input of this table; write a new version instead")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def merge_report(previous: DataFrame, new_rows: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """``previous`` with ``new_rows`` added; a key in both takes the new row.

    Running the same step twice therefore leaves one row per key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kept = previous.join(new_rows.select(*keys), keys, "left_anti")
    return kept.unionByName(new_rows)


def as_key_values(one_row: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """A one-row table as (key, value) text rows, each value in its given format."""
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.format_string(spec, F.col(k)).alias("value"))
            for k, spec in formats.items()
        ]
    )
    return one_row.select(F.inline(pairs))


def write_key_values(pairs: DataFrame, path: str) -> None:
    lines = pairs.select(F.concat_ws("=", "key", "value").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path).filter(F.col("value").contains("="))
    return text.select(
        F.trim(F.substring_index("value", "=", 1)).alias("key"),
        F.trim(F.expr("substr(value, instr(value, '=') + 1)")).alias("value"),
    )
