"""Relational and cell operators."""
