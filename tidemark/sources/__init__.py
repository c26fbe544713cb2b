"""Readers, adapters and sinks for series and component tables."""
