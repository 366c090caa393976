"""Waymark: a gazetteer search engine on PySpark."""
