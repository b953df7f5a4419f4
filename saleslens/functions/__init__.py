"""Column helpers shared by the jobs; built-in Spark functions only."""
