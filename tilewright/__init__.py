"""Manifest analytics for weakly supervised image cohorts, and training-text preparation, on Spark."""
