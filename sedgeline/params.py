"""Parameters of filtering, features and clustering. They equal the published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    distance_cutoff_km: float = 80.0
    dose_threshold: float = 0.10
    min_dates: int = 4
    early_late_cutoff: str = "2013-03-11"
    log_floor: float = 1e-6
    rise_ratio: float = 0.5
    rise_step: float = 0.05
    slope_guard: float = 5e-6
    half_life_cap: float = 100.0
    clip: float = 3.0
    earth_radius_km: float = 6371.0
    site_latitude: float = 37.421389
    site_longitude: float = 141.032778


DEFAULT = Params()
#: The nine features that are scaled and clustered, in order.
FEATURES = (
    "total_decay_ratio", "log_linear_slope", "log_linear_r2", "early_slope", "late_slope",
    "residual_cv", "slope_ratio", "n_increases", "temporal_span_years",
)
#: Measurement types in order of preference where a mesh has as many of each.
TYPE_PRIORITY = ("Walk", "Car", "AirBorne", "定点")
#: The columns that features are computed from.
REQUIRED = (
    "mesh_id_250m", "correction_date", "value", "distance_from_fdnpp_km", "latitude", "longitude",
    "measurement_type", "year", "is_decontaminated", "height_anomalous", "source_item", "source_class",
)
