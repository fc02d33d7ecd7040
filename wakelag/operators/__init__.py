"""Relational operators over quotes, intervals, pairs and components."""
