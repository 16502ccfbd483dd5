"""Demand time-series analytics written as Spark DataFrame plans."""

from seriesmill.config import (
    AssumptionRule,
    ForecastConfig,
    HierarchyConfig,
    MappingConfig,
    RegressorSpec,
    Scenario,
    StudyConfig,
    TreatmentPolicy,
)

__all__ = [
    "AssumptionRule",
    "ForecastConfig",
    "HierarchyConfig",
    "MappingConfig",
    "RegressorSpec",
    "Scenario",
    "StudyConfig",
    "TreatmentPolicy",
]
