"""Operators of a training-data pipeline: one module for each operator.

Nothing outside this subpackage imports it.
"""
