"""Readers of draw tables, archives, results and ledgers."""
