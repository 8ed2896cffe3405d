"""Orbit and space-weather analytics expressed as Spark DataFrame plans."""
