"""Surface analytics as Spark DataFrame transformations."""
