"""Recommendation analytics over interaction logs and text, as Spark DataFrame operators."""
