"""Readers of landed payloads and writers of results."""
