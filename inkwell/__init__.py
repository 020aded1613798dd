"""Inkwell: text analytics on PySpark."""
