"""Readers, sinks and the stand-in tables used for checking."""
