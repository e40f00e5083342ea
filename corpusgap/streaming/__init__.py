"""Structured Streaming jobs over the append logs; each equals its batch twin once all input is read."""
