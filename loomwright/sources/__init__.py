"""Readers, writers and provider interfaces."""
