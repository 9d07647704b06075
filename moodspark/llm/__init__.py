"""Operators of a training-data pipeline.

One module per operator; ``queries`` registers one query for each.  Nothing
outside this package imports it.
"""
