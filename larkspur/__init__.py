"""A source-code audit engine and text-processing library on PySpark."""
