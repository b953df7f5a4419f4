"""The jobs. Each takes named tables and parameters and returns a DataFrame."""
