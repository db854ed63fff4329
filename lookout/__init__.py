"""Posting watch on Spark: DataFrame operators for feeds of text records."""
