"""Settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Names and vocabularies that results are compared on.
OUTPUT_NODE = "prediction"
CONTINUOUS = "continuous"
CATEGORICAL = "categorical"
RAW_INPUT = "raw_input"
DERIVED_FEATURE = "derived_feature"
MODEL_OUTPUT = "model_output"
NODE_KINDS = (RAW_INPUT, DERIVED_FEATURE, MODEL_OUTPUT)
DRIFT = "DRIFT"
WARNING = "WARNING"
STABLE = "STABLE"
INSUFFICIENT_DATA = "INSUFFICIENT_DATA"
ROOT_CAUSE = "ROOT_CAUSE"
SYMPTOM = "SYMPTOM"
SCHEMA_VERSION = "1.0"
DEFAULT_SOURCE = "api"
PII_DENY_LIST = ("name", "email", "phone", "ssn", "address", "customer_id", "account_number")
PSI_EPSILON = 1e-6


@dataclass(frozen=True)
class DriftConfig:
    """Thresholds and window policy; every field can be overridden."""

    ks_pvalue: float = 0.05
    psi_warning: float = 0.1
    psi_drift: float = 0.2
    min_samples: int = 30
    psi_bins: int = 10
    window_size: int = 500
    window_min_samples: int = 100
    cooldown_seconds: int = 900
    open_after: int = 2
    close_after: int = 3
    baseline_cap: int | None = None  # reference values kept per node; None keeps all
    output_rows: int | None = None  # first reference rows of the output node; None takes all
    min_reference_rows: int = 20


DEFAULTS = DriftConfig()
