"""plansieve: Spark-native analytics over vector drawings held as relations."""

__version__ = "0.1.0"
