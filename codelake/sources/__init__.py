"""Readers: base tables, derived views, repository files, SQL dumps, fixed dimensions, sinks."""
