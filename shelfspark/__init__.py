"""Inventory and reorder analytics as Spark DataFrame operators."""
