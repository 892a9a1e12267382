"""A Spark-native engine for Turkish morphological analysis of text at scale."""
