"""Operators of a training-data pipeline over document collections. Nothing outside this subpackage imports it."""
