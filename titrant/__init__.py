"""titrant: laboratory result analytics as Spark DataFrame operators."""
