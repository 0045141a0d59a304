"""Profiling, preparation and evaluation of datasets as Spark DataFrame jobs."""

__version__ = "0.1.0"
