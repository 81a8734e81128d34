"""Readers and writers for the tables the jobs exchange."""
