"""Wildfire situational analytics as PySpark DataFrame operators."""
