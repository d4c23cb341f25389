"""Spark-native event formation engine: decode, validate, cluster, match, reduce, batch."""
