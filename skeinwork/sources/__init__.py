"""Scans, stores and parsers."""
