"""A Spark-native engine for media index tables and training-corpus operators."""
