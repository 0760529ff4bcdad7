"""Monitoring reports and whole jobs built from the operators."""
