"""Temporal panel analytics on Spark: DataFrame in, DataFrame out."""
