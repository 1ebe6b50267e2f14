"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Joins and windows keyed by (entity, date) may reuse a hash partitioning by entity alone.
    # A panel holds one row per entity and month, so an entity never outgrows the calendar.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# A scan is cut, and a finely cut shuffle joined up, to parts of this size, so that the hash tables and sorts of a task fit its
# memory however large the input is. Several windows sort the same wide rows in one task, each holding them uncompressed.
_PART_BYTES = 16 << 20
_PART_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
_SHUFFLE_PARTS = 400


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are planned for; smaller parts chosen by the caller stay."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key in _PART_SIZES:
        if in_bytes(spark.conf.get(key)) > _PART_BYTES:
            spark.conf.set(key, f"{_PART_BYTES}b")
    parts = max(_SHUFFLE_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written stages: the cluster's checkpoint folder, a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; stages need a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="panelstress-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_WRITTEN: list[str] = []


def stage_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new place below the given folder, or the session's; remembered for :func:`remove_stages`."""
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def remove_stages(spark: SparkSession, first: int = 0) -> int:
    """Delete the stages that this process has written, from the given number on, when nothing reads them any more.

    ``first`` is the value of :func:`stages_written` before the work whose stages may go. Returns how many went.
    """
    paths = _WRITTEN[first:]
    del _WRITTEN[first:]
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def stages_written() -> int:
    return len(_WRITTEN)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Write a stage as Parquet and read it back: it survives lost executors and keeps column pruning."""
    path = stage_path(df.sparkSession, name, folder)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
