"""Column functions and vectorised UDFs."""
