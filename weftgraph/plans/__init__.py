"""Registered queries over the test tables, with the same queries in SQL."""
