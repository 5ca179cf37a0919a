"""Operators of the terrain and line analytics."""
