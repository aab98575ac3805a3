"""Operators over notes and links."""
