"""Operators for large text collections. Nothing outside this folder imports it."""
