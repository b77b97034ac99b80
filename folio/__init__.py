"""A Spark-native engine for study analytics, document structure and training-data preparation."""
