"""Readers and writers: file trees, graph JSON, tables."""
