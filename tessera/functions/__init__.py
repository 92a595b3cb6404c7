"""Functions of the sensor engine."""
