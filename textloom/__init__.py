"""A Spark-native engine that turns text into tokens, vectors, scores and ranked results."""
