"""Incremental intake of daily files."""
