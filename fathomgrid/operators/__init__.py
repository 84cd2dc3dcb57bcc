"""Partitioning, nearest neighbours, outlier factors, pivot selection and point operators."""
