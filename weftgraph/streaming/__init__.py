"""Streaming counterparts of the incremental build."""
