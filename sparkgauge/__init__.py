"""Measurement catalogues, curves, agreement statistics and ranking metrics on Spark."""
