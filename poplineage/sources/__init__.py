"""Readers and writers: event logs, sectioned snapshot text, result tables."""
