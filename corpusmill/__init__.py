"""Corpus analytics on PySpark."""
