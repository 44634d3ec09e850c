"""Readers and feed parsers."""
