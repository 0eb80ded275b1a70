"""Readers, writers, schema inference and table maintenance."""
