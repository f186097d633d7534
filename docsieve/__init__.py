"""Document-screening analytics as Spark DataFrame operators."""
