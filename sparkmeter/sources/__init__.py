"""Readers, normalisation to silver tables, and sinks."""
