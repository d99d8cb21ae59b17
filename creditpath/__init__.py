"""Marketing attribution and ad-budget analytics as PySpark DataFrame operators."""
