"""Provenant: evidence-first document analytics as composable Spark DataFrame transformations."""
