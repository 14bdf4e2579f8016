"""Structured Streaming forms of the sensor operators."""
