"""Operators over ticks, windows and articles."""
