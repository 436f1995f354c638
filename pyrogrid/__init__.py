"""Thermal-anomaly analytics as Spark DataFrame operators."""
