"""Readers and writers of record formats."""
