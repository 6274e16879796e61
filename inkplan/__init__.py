"""A Spark-native engine that turns collections of documents into Markdown and queryable tables."""
