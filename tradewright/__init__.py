"""Trader-skill analytics as Spark DataFrame jobs."""
