"""Sensor streams, point-cloud maps and training text on Spark DataFrames."""
