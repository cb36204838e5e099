"""Readers and writers of stored artefacts."""
