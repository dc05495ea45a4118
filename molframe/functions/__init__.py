"""Subpackage of molframe."""
