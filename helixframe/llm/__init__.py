"""Operators of a large training-data pipeline; nothing else in the library imports this subpackage."""
