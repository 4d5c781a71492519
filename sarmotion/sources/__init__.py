"""Readers for radar products."""
