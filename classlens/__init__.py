"""Two-class feature analytics as Spark DataFrame transformations."""
