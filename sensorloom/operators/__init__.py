"""Lazy DataFrame operators over long ``(series, ts, value)`` tables."""
