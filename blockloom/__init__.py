"""blockloom: a Spark-native analytics engine for document-block data."""

__version__ = "0.1.0"
