"""New log drops into the mergeable log state, file by file, with Structured Streaming.

Every micro-batch becomes one partial state written under its own batch
number. A batch that is repeated after a failure overwrites the same
directory, so it is counted once. Reading merges the partials; nothing that
was already ingested is read again from the raw files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbtide.operators.logs import finish_log_features, log_partial, merge_log_partials
from ebbtide.sources.layouts import USER_LOGS


def ingest_log_drops(
    spark: SparkSession,
    landing: str,
    state: str,
    checkpoint: str,
    fmt: str = "csv",
    above: float = 0.0,
    up_to: float = 90000.0,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take in every file that is new in ``landing``, then stop."""
    reader = spark.readStream.schema(USER_LOGS).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def keep(batch: DataFrame, batch_id: int) -> None:
        log_partial(batch, above, up_to).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    return (
        reader.load(landing)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_log_state(spark: SparkSession, state: str) -> DataFrame:
    """One merged partial row per subscriber."""
    return merge_log_partials([spark.read.parquet(state).drop("batch_id")])


def log_features_from_state(spark: SparkSession, state: str, labels: DataFrame, snapshot: str) -> DataFrame:
    labelled = read_log_state(spark, state).join(labels.select(F.col("msno")), "msno", "left_semi")
    return finish_log_features(labelled, snapshot)


def compact_log_state(spark: SparkSession, state: str, compacted: str) -> None:
    """Write the merged state to a new place, to be used as a single partial from then on."""
    read_log_state(spark, state).write.mode("errorifexists").parquet(f"{compacted}/batch_id=-1")
