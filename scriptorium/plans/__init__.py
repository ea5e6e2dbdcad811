"""Queries over the driver's tables, composed from the operators."""
