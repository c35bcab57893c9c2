"""quillstream: a Spark-native engine for time-aligned text."""
