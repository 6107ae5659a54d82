"""logshape: a PySpark-native engine for log templates, dictionary encoding and file comparison."""

__version__ = "0.1.0"
