"""A PySpark-native engine for conversation logs, retrieval and training-data preparation."""
