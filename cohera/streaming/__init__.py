"""Structured Streaming variants of the online paths (ST1-ST3)."""
