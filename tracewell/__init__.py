"""tracewell: a Spark-native engine for archives of chat and work material with known provenance."""

__version__ = "0.1.0"
