"""Declared schemas, CSV loading, and the test tables in the shape of the jobs."""
