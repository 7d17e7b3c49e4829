"""Structured Streaming forms of the stateful operators; each has a batch form to be held against."""
