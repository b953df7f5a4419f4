"""Customer, sales and transaction analytics as Spark DataFrame jobs."""
