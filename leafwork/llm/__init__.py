"""Operators of a training-data pipeline. Nothing else in leafwork imports this package."""
