"""Queries over the standard tables and their oracles."""
