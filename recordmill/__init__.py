"""A Spark-native engine for querying stores of JSON records and compiled notes."""
