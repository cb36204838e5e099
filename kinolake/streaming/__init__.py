"""Incremental forms of batch operators for samples, files and events that keep arriving."""
