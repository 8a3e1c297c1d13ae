"""Reads, writes and maintenance over a versioned op table, as DataFrame programs."""
