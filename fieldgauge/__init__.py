"""Spark jobs that decide whether K kept coefficients can stand in for a full field."""

__version__ = "0.1.0"
