"""Frames as they arrive: Structured Streaming twins of batch operators."""
