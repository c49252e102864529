"""Weft: evidence-synthesis analytics written as Spark DataFrame operators."""
