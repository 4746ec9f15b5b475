"""Readers and writers of graph and matrix files."""
