"""Verdict columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoreline.config import DRIFT, INSUFFICIENT_DATA, STABLE, WARNING


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ks_verdict(p_value: Column | str, threshold: Column | str | float) -> Column:
    """DRIFT when the p-value is below the threshold; null p means too few samples."""
    p = _col(p_value)
    t = F.lit(threshold) if isinstance(threshold, float) else _col(threshold)
    return (
        F.when(p.isNull(), INSUFFICIENT_DATA).when(p < t, DRIFT).otherwise(STABLE)
    )


def psi_verdict(psi: Column | str, warning: Column | float, drift: Column | float) -> Column:
    """Bands of the stability index; null means too few samples."""
    v = _col(psi)
    return (
        F.when(v.isNull(), INSUFFICIENT_DATA)
        .when(v >= drift, DRIFT)
        .when(v >= warning, WARNING)
        .otherwise(STABLE)
    )


def combine_verdict(ks: Column | str, psi: Column | str) -> Column:
    """One verdict per node. A missing test is null or INSUFFICIENT_DATA."""
    ks_v = F.coalesce(_col(ks), F.lit(INSUFFICIENT_DATA))
    psi_v = F.coalesce(_col(psi), F.lit(INSUFFICIENT_DATA))
    return (
        F.when((ks_v == INSUFFICIENT_DATA) & (psi_v == INSUFFICIENT_DATA), INSUFFICIENT_DATA)
        .when((psi_v == DRIFT) | ((ks_v == DRIFT) & (psi_v == WARNING)), DRIFT)
        .when((psi_v == WARNING) | (ks_v == DRIFT), WARNING)
        .otherwise(STABLE)
    )
