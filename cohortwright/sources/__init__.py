"""Readers and writers for tables, matrices, gene sets and summaries."""
