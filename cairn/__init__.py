"""Versioned, content-addressed data on Spark."""
