"""weftlex: Spark-native lexical memory analytics."""

__version__ = "0.1.0"
