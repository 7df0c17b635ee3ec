"""Refund-abuse analytics as Spark DataFrame jobs."""
