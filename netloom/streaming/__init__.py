"""Structured Streaming forms of the window, feature and alert operators."""
