"""Registered queries over the order graph, and the SQL that says the same."""
