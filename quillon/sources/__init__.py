"""Readers of landed files and writers of versioned tables."""
