"""Streaming forms of the aggregates: an extension, for tables that keep growing."""
