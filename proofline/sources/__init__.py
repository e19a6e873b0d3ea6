"""Readers, row linearisation, document registration and sinks."""
