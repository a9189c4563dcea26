"""Operators for training-data pipelines; ``queries`` registers them."""
