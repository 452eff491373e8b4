"""Readers, writers and the profile adapter."""
