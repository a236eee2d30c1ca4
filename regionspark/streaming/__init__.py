"""Streaming use of the batch operators."""
