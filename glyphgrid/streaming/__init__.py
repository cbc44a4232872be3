"""Streams of animation bytes that arrive in chunks."""
