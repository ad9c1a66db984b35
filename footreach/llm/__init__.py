"""Operators for training-data pipelines: ten numbered operators, one module each. Nothing outside imports this package."""
