"""Spark-first analytics on (entity, date) panels."""
