"""Readers and writers of imaging and event formats."""
