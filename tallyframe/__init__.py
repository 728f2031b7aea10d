"""Labelled-dataset audit, splitting, evaluation and run selection on Spark."""

__version__ = "0.1.0"
