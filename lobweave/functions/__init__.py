"""Column builders: decimal arithmetic and features."""
