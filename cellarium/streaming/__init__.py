"""Edits as streams."""
