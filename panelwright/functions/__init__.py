"""Tail probabilities, corrections and projections."""
