"""Speech-corpus analytics as Spark DataFrame operators."""
