"""Retail price analytics as Spark DataFrame jobs."""
