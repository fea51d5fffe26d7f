"""Lineage analytics on Spark: code-lineage, sensitive-column access and training-data operators."""
