"""Reusable DataFrame operators: quantiles, filters, dedupe, merge, bands."""
