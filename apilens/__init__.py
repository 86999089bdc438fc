"""HTTP API traffic analytics as Spark DataFrame operators."""
