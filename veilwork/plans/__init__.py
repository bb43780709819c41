"""Encoders, models, feature ranking, sensitivity analysis and searches over masks."""
