"""Operators on event, lifetime, snapshot and tree tables."""
