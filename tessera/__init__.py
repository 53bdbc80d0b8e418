"""PySpark-native similarity, clustering and text-profiling engine."""

__version__ = "0.1.0"
