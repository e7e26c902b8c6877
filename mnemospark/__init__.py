"""A PySpark-native store and retrieval engine for text records."""
