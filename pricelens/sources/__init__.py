"""Readers, sinks and the adapter from the benchmark tables to listings."""
