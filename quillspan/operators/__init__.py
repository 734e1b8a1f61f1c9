"""Operators that compose DataFrame operations: table access, graphs, trees, lookups, change logs, path catalogues."""
