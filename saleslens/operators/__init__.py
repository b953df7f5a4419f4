"""Operators that several jobs share."""
