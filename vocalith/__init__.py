"""Segment, interval and speaker-vector analytics on Spark DataFrames."""
