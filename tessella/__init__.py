"""Tessella: a Spark-native engine for matching, ranking and assembling fragments."""
