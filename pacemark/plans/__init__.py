"""Registered queries: a Spark plan each, and SQL for the same result where there is any."""
