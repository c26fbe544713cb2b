"""Operators over long series tables ``(series_id, t, ...)``."""
