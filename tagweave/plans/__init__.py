"""Selectors as plans: parsed, ordered by cost, printed."""
