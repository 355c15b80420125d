"""Operators of a training-data pipeline: one module for each, `queries` for the registered entry points."""
