"""Media framing analytics as Spark DataFrame operators."""
