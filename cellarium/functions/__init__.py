"""Column functions: byte codecs, key helpers and comparators."""
