"""Scalar functions: Spark columns and their Python counterparts for importers."""
