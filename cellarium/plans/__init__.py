"""Filter trees, their text forms, and their compilation into columns."""
