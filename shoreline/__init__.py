"""Drift monitoring of machine-learning data on Spark."""

from shoreline.config import DEFAULTS, DriftConfig

__all__ = ["DEFAULTS", "DriftConfig"]
