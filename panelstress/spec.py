"""Parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# The six components, their index and its classes.
COMPONENTS = (
    "spi_stress_z",
    "soil_stress_z",
    "ndvi_stress_z",
    "lst_stress_z",
    "groundwater_stress_z",
    "surface_water_stress_z",
)
INDEX = "wsi"
CLASS_UPPER_BOUNDS = (
    ("Very Wet", -1.5),
    ("Wet", -0.5),
    ("Normal", 0.5),
    ("Moderate Stress", 1.5),
    ("Severe Stress", None),
)
# Columns of the model dataset.
MODEL_COLUMNS = (
    "date", "year", "month", "split", *COMPONENTS,
    "groundwater_stale_flag", "months_since_last_gw_obs", "ndvi_imputed", "lst_imputed",
    "wsi", "wsi_category",
)
# Layer depths, ridge penalties, event thresholds and constants of the panel.
SOIL_LAYER_DEPTHS_MM = (70.0, 210.0, 720.0, 1890.0)
RIDGE_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
EVENT_THRESHOLDS = (("stress", 0.5), ("severe", 1.5))
NEVER_OBSERVED_AGE = 999
DEFAULT_DEPTH = 10.0
STD_FLOOR = 1e-6
ZERO_RAIN = 0.001
PROBABILITY_CLIP = 1e-7


@dataclass(frozen=True)
class SplitPolicy:
    """Inclusive forecast-origin ranges; an origin outside all of them belongs to no split."""

    train: tuple[str, str]
    val: tuple[str, str]
    test: tuple[str, str]

    def ranges(self) -> list[tuple[str, str, str]]:
        return [("train", *self.train), ("val", *self.val), ("test", *self.test)]


@dataclass(frozen=True)
class PanelSpec:
    """Column names and period boundaries of one panel."""

    start: str
    end: str
    train_end: str
    val_end: str
    origins: SplitPolicy
    entity: str = "entity"
    date: str = "date"
    calibration_start: str = "1981-01-01"
    min_wells: int = 10
    well_thresholds: tuple[int, ...] = (5, 10, 15)
    stale_months: int = 3
    lookback: int = 12
    horizon: int = 3
    water_lag: bool = False
    components: tuple[str, ...] = field(default=COMPONENTS)

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.date]
