"""cadenza: a PySpark-native engine for content discovery and recommendation."""
