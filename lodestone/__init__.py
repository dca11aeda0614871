"""lodestone: a Spark-native code-intelligence and corpus-analytics library."""

__version__ = "0.1.0"
