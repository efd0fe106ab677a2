"""Structured Streaming twins of the stateful detectors."""
