"""Operators for preparing training data: ten methods over documents and pages, and their queries."""
