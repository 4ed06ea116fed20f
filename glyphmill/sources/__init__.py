"""Scans and sinks of dictionary, rule and suggestion files."""
