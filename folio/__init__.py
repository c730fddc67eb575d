"""Spark-native analytics over text regions, text pairs and job event streams."""
