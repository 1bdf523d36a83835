"""Whole plans: exports to message formats and Markdown."""
