"""Structured Streaming sinks and stateful operators."""
