"""Operators over pages and over the relation of nodes."""
