"""Readers: file trees, commit logs."""
