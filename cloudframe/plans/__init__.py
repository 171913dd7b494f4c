"""Workflows that chain operators end to end."""
