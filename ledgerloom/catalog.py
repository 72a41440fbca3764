"""Modules that register queries."""

from .plans import audits, concentration, diagnostics, incidence, interrupted, models, named, panelmodels, protocols, relational, resampling, robustness, timeseries  # noqa: F401
