"""Readers: driver tables as graph tables, and transcript formats."""
