"""Composed jobs: the entry points users call."""
