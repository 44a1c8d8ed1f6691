"""tidemark: a Spark-native analytics engine for opinionated discussion data."""
