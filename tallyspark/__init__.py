"""Spark-native analytics on token-usage logs, and on any table with events in time."""
