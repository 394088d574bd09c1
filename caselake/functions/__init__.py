"""Placeholder."""
