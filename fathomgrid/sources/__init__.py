"""Readers that give points, pivots and groups, and writers for results."""
