"""Registered queries, their SQL and helpers for plans with several steps."""
