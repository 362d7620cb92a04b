"""rallylake: Spark-native analytics for a sports-video service, declared with DataFrames and SQL."""
