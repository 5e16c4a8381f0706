"""Stateless use of the operators on streams."""
