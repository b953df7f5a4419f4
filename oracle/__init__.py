"""Independent SQL for every registered query, for the checking engine."""
