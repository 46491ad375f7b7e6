"""Queries over the driver's tables, composed of the operators, with their SQL equivalents."""
