"""Call-transcript analytics as Spark DataFrame operators."""
