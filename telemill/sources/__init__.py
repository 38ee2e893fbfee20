"""Readers: driver tables and their bridge views, stream lines, sample tables."""
