"""Panels as data, and the registry of queries with their SQL."""
