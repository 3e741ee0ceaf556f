"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ebbtide", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config(
            "spark.driver.memory", "12g"
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def in_one_process(master: str) -> bool:
    """Whether driver and executors are one process: ``local`` or ``local[...]``, but not ``local-cluster[...]``."""
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session in one process may fall back to a temporary folder: where
    executors are processes of their own, even on one machine, a local path may
    be out of their reach or lost with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not in_one_process(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="ebbtide-")
    sc.setCheckpointDir(made)
    return made


def stage(df: DataFrame, label: str = "table", partition_by: tuple = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later uses start from the written files: lineage is cut, a lost executor
    costs a re-read, and Catalyst knows the real size, so whether a join
    broadcasts this side is decided against spark.sql.autoBroadcastJoinThreshold
    on measured bytes rather than on a guess.
    """
    path = f"{staging_dir(df.sparkSession).rstrip('/')}/ebbtide/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    made = _made.get()
    if made is not None:
        made.append(path)
    writer.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[staged] = path
    return staged


# folders of staged tables, and of those made within the innermost ``settle``
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Remove the files of a table that ``stage`` returned and nothing reads any more."""
    _remove(table.sparkSession, _paths.pop(table))


def settle(build: Callable[[], DataFrame], label: str = "table") -> DataFrame:
    """``stage`` what ``build`` returns, and remove the tables that were staged for it in this thread.

    Nothing else may read these. Where ``build`` fails they stay.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        table = build()
    finally:
        _made.reset(token)
    settled = stage_tidily(table, label)
    for path in made:
        _remove(settled.sparkSession, path)
    return settled


# Spark's setting that removes an execution's shuffle files when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_tidily(df: DataFrame, label: str = "table") -> DataFrame:
    """``stage`` for a table whose making shuffles much: its shuffle files go as soon as it is written.

    Otherwise they stay until the driver happens to collect its garbage. Not
    for fits side by side, as the setting is the session's.
    """
    conf = df.sparkSession.conf
    before = conf.get(TIDY, "false")
    conf.set(TIDY, "true")
    try:
        return stage(df, label)
    finally:
        conf.set(TIDY, before)
