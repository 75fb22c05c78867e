"""Readers for landed documents and sinks for result tables."""
