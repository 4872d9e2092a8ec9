"""Operators and queries of a training-data pipeline.

One module per operator; ``queries`` holds the registered queries and their SQL twins.
Nothing else in the library imports this subpackage.
"""
