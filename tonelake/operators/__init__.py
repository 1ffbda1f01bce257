"""Relational, similarity, history and evaluation operators over DataFrames."""
