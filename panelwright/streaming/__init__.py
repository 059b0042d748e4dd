"""Structured Streaming over draws and ledgers."""
