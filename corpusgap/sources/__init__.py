"""Readers of landed payloads and writers of reports."""
