"""Operators on nodes, edges, commits, vectors and text."""
