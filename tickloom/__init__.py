"""Spark-native analytics for dated market events: bars, features, backtests and document routing."""
