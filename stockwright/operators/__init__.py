"""Relational and domain operators over the canonical panel."""
