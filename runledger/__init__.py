"""Spark-native analytics over machine-learning evaluation records and their lineage."""
