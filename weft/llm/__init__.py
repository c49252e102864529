"""Training-data operators: dedup, filters, classifiers, scoring and mixing.

Nothing outside this package imports it.
"""
