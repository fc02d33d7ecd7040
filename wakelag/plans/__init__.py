"""Queries over the driver's tables that exercise the operators end to end."""
