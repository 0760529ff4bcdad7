"""Readers, the append-only fact tables, the registry and event envelopes."""
