"""quillon: a PySpark-native engine for large text-and-knowledge corpora."""

__version__ = "0.1.0"
