"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch that a Python task holds at once; the default of 10,000 suits rows much shorter than texts.
BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of fewer rows: two Python tasks and an executor's heap have to fit in its memory together."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
