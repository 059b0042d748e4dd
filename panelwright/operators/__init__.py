"""Operators over draws and their dense panel."""
