"""Maritime news and vessel-track analytics as Spark DataFrame operators."""
