"""Marketplace sales analytics as PySpark DataFrame operators."""
