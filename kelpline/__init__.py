"""kelpline: a PySpark-native engine for source-trust, drift and corpus analytics."""

__version__ = "0.1.0"
