"""Governed metrics, profiling, retrieval and evaluation as Spark DataFrame plans."""
