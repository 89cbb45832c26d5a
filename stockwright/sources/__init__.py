"""Readers that bring raw tables into the canonical shapes, and sinks."""
