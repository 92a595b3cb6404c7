"""Sources of the sensor engine."""
