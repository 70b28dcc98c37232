"""Listing price analytics expressed as Spark DataFrame jobs."""
