"""Ride telemetry analytics on Spark DataFrames, in batch and in Structured Streaming."""
