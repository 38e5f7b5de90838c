"""Labelled short-text preparation, features, classifiers and evaluation on Spark."""

__version__ = "0.1.0"
