"""Density-based outlier analytics as DataFrame plans."""
