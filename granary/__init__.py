"""Granary: sequence-dataset preparation as Spark DataFrame plans."""

__version__ = "0.1.0"
