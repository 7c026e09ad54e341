"""Tessera: an embedded-SQL dialect and data-processing toolkit on PySpark."""

__version__ = "0.1.0"
