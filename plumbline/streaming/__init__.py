"""Continuous drift watch."""
