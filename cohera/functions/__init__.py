"""Column-expression helpers (pure Spark SQL expressions, no UDFs)."""
