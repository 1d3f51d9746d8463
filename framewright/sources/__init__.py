"""Readers that give typed tables, and writers of results."""
