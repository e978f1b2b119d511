"""Document-knowledge analytics as Spark DataFrame plans."""
