"""Encoding of text streams."""
