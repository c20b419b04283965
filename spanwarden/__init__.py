"""Sensitive-data detection, policy and evidence engine for PySpark."""

__version__ = "0.1.0"
