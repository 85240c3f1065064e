"""Registered queries: one per operator, with SQL for the check where SQL can express it."""

from __future__ import annotations

from shoreline.queries import basics, causes, drift, monitoring, profiling, quality

_MODULES = (basics, profiling, drift, causes, monitoring, quality)

REGISTERED = {name: entry for module in _MODULES for name, entry in module.QUERIES.items()}
