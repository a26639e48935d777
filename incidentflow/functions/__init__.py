"""Column-expression helpers (built-in Spark functions only, no Python UDFs)."""
