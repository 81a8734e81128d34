"""Operators for large text corpora. Nothing outside this subpackage imports it."""
