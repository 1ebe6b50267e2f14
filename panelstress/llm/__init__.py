"""Operators for training-data pipelines: one module per operator, and the registered queries."""
