"""Structured Streaming entry: each arriving upload runs the batch plan."""
