"""Readers, writers and the versioned document catalog."""
