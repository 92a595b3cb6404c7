"""Operators of the sensor engine."""
