"""Land-use analytics as Spark DataFrame operators."""
