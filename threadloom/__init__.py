"""Spark-first analytics over conversation archives."""
