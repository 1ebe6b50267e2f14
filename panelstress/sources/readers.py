"""Readers with explicit schemas, cleaning and structural contracts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstress.functions.numeric import calendar_date, numeric
from panelstress.operators import clean
from panelstress.operators.audit import panel_contract, require_passed
from panelstress.spec import COMPONENTS, INDEX, PanelSpec


@dataclass(frozen=True)
class StreamSource:
    """Schema and bounds of one monthly stream: bounds are (lower, upper, strict lower)."""

    name: str
    values: tuple[str, ...]
    bounds: dict[str, tuple]


# Column names and physical bounds of the raw monthly streams.
RAINFALL = StreamSource("rainfall", ("rainfall_mm",), {"rainfall_mm": (0.0, None)})
SOIL = StreamSource(
    "soil",
    ("soil_water_layer_1", "soil_water_layer_2", "soil_water_layer_3", "soil_water_layer_4",
     "soil_water_storage_mm_0_289cm"),
    {
        "soil_water_layer_1": (0.0, 1.0),
        "soil_water_layer_2": (0.0, 1.0),
        "soil_water_layer_3": (0.0, 1.0),
        "soil_water_layer_4": (0.0, 1.0),
        "soil_water_storage_mm_0_289cm": (0.0, None),
    },
)
VEGETATION = StreamSource("vegetation", ("ndvi",), {"ndvi": (-1.0, 1.0)})
TEMPERATURE = StreamSource("temperature", ("lst_celsius",), {"lst_celsius": (0.0, 70.0)})
SURFACE_WATER = StreamSource(
    "surface water", ("surface_water_frequency", "valid_pixels"),
    {"surface_water_frequency": (0.0, 1.0), "valid_pixels": (0.0, None, True)},
)
WELL_COLUMNS = ("block", "village", "latitude", "longitude", "well_depth_m")


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each file; the lines of a file's first block come in order, to one task."""
    seen = set()
    for batch in batches:
        paths = batch.column(0).to_pandas()
        first = [i for i in np.flatnonzero(paths.ne(paths.shift())) if paths[i] not in seen]
        seen.update(paths[first])
        if first:
            yield pa.RecordBatch.from_arrays([c.take(pa.array(first)) for c in batch.columns], names=["file_path", "header"])


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text: coercion is ours, so bad text becomes NULL instead of an error.

    Files of one folder may order their columns differently: each file is read by its own header. The headers, one
    line per file, are compared first; files with the same header are read together.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where("file_block_start = 0")
    first = lines.select("file_path", "value").mapInArrow(_first_lines, "file_path string, header string")
    files: dict[str, list[str]] = {}
    for row in first.groupBy("header").agg(F.collect_list("file_path").alias("files")).orderBy("header").collect():
        files[row.header] = row.files
    if len(files) <= 1:
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    parts = [spark.read.option("header", True).option("inferSchema", False).csv(f) for f in files.values()]
    names = set(parts[0].columns)
    if any(set(p.columns) != names for p in parts):
        raise ValueError(f"files of {path} have different columns: {sorted({tuple(p.columns) for p in parts})}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prepare_stream(
    raw: DataFrame, source: StreamSource, entity: str = "entity",
    aliases: DataFrame | dict | None = None, members: DataFrame | list | None = None, validate: bool = True,
) -> DataFrame:
    """Normalise names, keep known entities, coerce values, anchor months and check the contract.

    The check is one aggregation over the stream; switch it off to stay lazy and audit later.
    """
    df = clean.normalize_entity(raw, entity, aliases)
    if members is not None:
        df = clean.keep_members(df, members, entity)
    df = clean.anchor_months(clean.coerce_numeric(df, list(source.values)), "date")
    df = df.select(entity, "date", "year", "month", *source.values)
    if validate:
        clean.require_contract(clean.contract_report(df, [entity, "date"], source.bounds), source.name)
    return df


def load_stream(spark: SparkSession, path: str, source: StreamSource, **options) -> DataFrame:
    return prepare_stream(read_text_table(spark, path), source, **options)


def load_rainfall(spark: SparkSession, path: str, **options) -> DataFrame:
    """Full history is kept: the rolling sums of the first calendar months need it."""
    return load_stream(spark, path, RAINFALL, **options)


def load_soil(spark: SparkSession, path: str, **options) -> DataFrame:
    return load_stream(spark, path, SOIL, **options)


def load_vegetation(spark: SparkSession, path: str, **options) -> DataFrame:
    return load_stream(spark, path, VEGETATION, **options)


def load_temperature(spark: SparkSession, path: str, **options) -> DataFrame:
    return load_stream(spark, path, TEMPERATURE, **options)


def load_surface_water(spark: SparkSession, path: str, **options) -> DataFrame:
    return load_stream(spark, path, SURFACE_WATER, **options)


def prepare_wells(
    raw: DataFrame, entity: str = "entity", aliases: DataFrame | dict | None = None,
    members: DataFrame | list | None = None,
) -> DataFrame:
    """Cleaned well readings with those attribute columns that exist."""
    df = clean.normalize_entity(raw, entity, aliases)
    if members is not None:
        df = clean.keep_members(df, members, entity)
    return clean.clean_observations(df, "well_id", "date", "water_level_m_bgl", entity, list(WELL_COLUMNS))


def load_wells(spark: SparkSession, path: str, **options) -> DataFrame:
    return prepare_wells(read_text_table(spark, path), **options)


def index_column(columns: list[str], strict: bool = False) -> str:
    """The stored index column, ``wsi`` or ``WSI``; ``strict`` refuses a table that has both."""
    found = [c for c in ("wsi", "WSI") if c in columns]
    if not found:
        raise KeyError(f"neither 'wsi' nor 'WSI' among {columns}")
    if strict and len(found) > 1:
        raise ValueError("both 'wsi' and 'WSI' are present")
    return found[0]


def prepare_model_dataset(raw: DataFrame, spec: PanelSpec, validate: bool = True, strict: bool = False) -> DataFrame:
    """Typed model dataset; the panel contract is enforced unless switched off."""
    stored = index_column(raw.columns, strict)
    required = [spec.entity, spec.date, *COMPONENTS]
    absent = [c for c in required if c not in raw.columns]
    if absent:
        raise KeyError(f"required columns are missing: {absent}")
    typed = {
        **{c: F.col(c).try_cast("int").alias(c) for c in ("year", "month", "months_since_last_gw_obs", "groundwater_stale_flag")},
        **{c: F.col(c).try_cast("boolean").alias(c) for c in ("ndvi_imputed", "lst_imputed")},
    }
    others = [typed[c] if c in typed else F.col(c) for c in raw.columns if c not in {*required, "wsi", "WSI"}]
    df = raw.select(
        spec.entity,
        calendar_date(spec.date).alias(spec.date),
        *[numeric(c).alias(c) for c in COMPONENTS],
        numeric(F.col(stored)).alias(INDEX),
        *others,
    )
    if validate:
        require_passed(panel_contract(df, [*COMPONENTS, INDEX], spec))
    return df


def load_model_dataset(spark: SparkSession, path: str, spec: PanelSpec, **options) -> DataFrame:
    return prepare_model_dataset(read_text_table(spark, path), spec, **options)


SEQUENCE_METADATA = ("sequence_id", "forecast_origin", "input_start", "input_end", "target_t1", "target_t2", "target_t3", "split")


def load_sequences(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """Stored sequences; the split is the partition column, so other splits are never read."""
    df = spark.read.parquet(path)
    return df.where(F.col("split").isin(*splits)) if splits else df


def load_residual_inputs(panel: DataFrame, sequences: DataFrame, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """Index per (entity, date) and sequence metadata, with strict column checks."""
    absent = [c for c in (*SEQUENCE_METADATA, spec.entity) if c not in sequences.columns]
    if absent:
        raise ValueError(f"sequence metadata lacks {absent}")
    stored = index_column(panel.columns, strict=True)
    return (
        panel.select(*spec.keys, F.col(stored).alias(INDEX)),
        sequences.select("sequence_id", spec.entity, *SEQUENCE_METADATA[1:]),
    )


def load_predictions(
    spark: SparkSession, path: str, baseline_path: str | None = None, reference: str = "Persistence"
) -> DataFrame:
    """Long predictions; the reference model comes from the baseline table when the file lacks it.

    Whether it is lacking is decided inside the plan by an anti join on the model name.
    """
    df = spark.read.parquet(path)
    if baseline_path is None:
        return df
    base = spark.read.parquet(baseline_path).where(F.col("model") == reference)
    known = df.where(F.col("model") == reference).select("model").distinct()
    return df.unionByName(base.join(known, "model", "left_anti").select(*df.columns))
