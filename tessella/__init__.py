"""tessella: a Spark-native analytics engine over DataFrames, SQL and Structured Streaming."""
