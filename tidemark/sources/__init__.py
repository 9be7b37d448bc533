"""Readers and writers of the files that a benchmark is made of."""
