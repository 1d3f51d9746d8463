"""Operators from frames to result tables."""
