"""Structured Streaming over the event table: an addition to the batch operators."""
