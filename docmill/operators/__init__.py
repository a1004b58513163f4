"""Filters, stages, windows, updates and searches as DataFrame operations."""
