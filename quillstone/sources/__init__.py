"""Readers of raw documents."""
