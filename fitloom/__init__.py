"""Fitloom: shared-formula analytics on PySpark."""
