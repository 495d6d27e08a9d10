"""Spark-native analytics for the data side of reasoning-model experiments."""
