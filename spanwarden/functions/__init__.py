"""Column builders and byte-level helpers."""
