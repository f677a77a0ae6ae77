"""Operators of a training-data pipeline. Nothing else in gridweave imports this subpackage."""
