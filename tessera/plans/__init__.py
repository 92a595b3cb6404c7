"""Plans of the sensor engine."""
