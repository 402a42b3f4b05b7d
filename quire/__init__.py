"""Document-catalog analytics as Spark DataFrame transformations."""
