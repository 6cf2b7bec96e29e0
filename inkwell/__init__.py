"""A Spark-native engine for crash-tolerant, append-only binary journals."""
