"""Structured Streaming over events: extensions beside the batch operators."""
