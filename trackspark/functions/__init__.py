"""Column builders: everything here returns a Spark expression (or is a small Arrow UDF)."""
