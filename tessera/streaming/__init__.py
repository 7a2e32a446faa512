"""Structured Streaming over event tables: an addition, not part of the parity set."""
