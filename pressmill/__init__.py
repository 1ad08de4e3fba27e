"""A Spark-native engine for collecting, canonicalising and deduplicating articles."""
