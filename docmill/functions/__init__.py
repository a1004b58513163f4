"""Expressions and accumulators of the document language as Columns."""
