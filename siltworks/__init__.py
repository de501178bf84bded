"""Siltworks: corpus preparation and analytics as plain Spark plans."""

__version__ = "0.1.0"
