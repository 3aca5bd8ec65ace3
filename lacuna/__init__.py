"""Lacuna: raw-data recovery analytics and training-data operators on PySpark."""
