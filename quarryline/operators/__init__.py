"""Relational operators over revision logs, snapshots, graphs and references."""
