"""A Spark-native engine that turns captured documents into typed, queryable tables."""
