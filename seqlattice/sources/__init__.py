"""Readers, writers and checks of the library's tables."""
