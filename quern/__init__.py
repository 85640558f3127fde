"""quern: a Spark-native engine for sparse, timestamped, schema-flexible tables."""
