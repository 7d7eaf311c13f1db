"""readroute: a PySpark-native engine for long-read single-cell sequencing data."""

__version__ = "0.1.0"
