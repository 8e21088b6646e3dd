"""Sextant: a Spark-first analytics engine for text-and-graph knowledge bases."""
