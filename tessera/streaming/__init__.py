"""Streaming of the sensor engine."""
