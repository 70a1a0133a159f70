"""Composed flows and the registry of checked queries."""
