"""A Spark-native engine for iterative graph analytics."""
