"""Pipelines over unbounded tables."""
