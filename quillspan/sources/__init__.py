"""Readers of formats that Spark has no source for."""
